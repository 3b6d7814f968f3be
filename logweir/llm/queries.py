"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import (
    bpe,
    dual_tree,
    edit_counts,
    fm_quality,
    near_dups,
    packing,
    quality_rules,
    quote_links,
    sharding,
    suffix_dedup,
    token_files,
    topk,
    whitening,
)
from logweir.llm.common import stored, table, working_dir

ORACLES: dict[str, str] = {}


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 byte by byte, with the table made from its polynomial.
ORACLES["op6_sampled_splitters"] = """
with recursive steps(i, c, k) as (
  select i, i::bigint, 0 from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), crc as (select list(c order by i) as t from steps where k = 8),
sized as (
  select doc_id, coalesce(text, '') as body, strlen(coalesce(text, '')) + 1 as size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as key
  from documents
), bytes as (
  select doc_id, size, key, hex(encode(body)) as h, crc.t from sized, crc
), summed as (
  select doc_id, size, key, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(length(h) // 2),
      lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) as text_crc32
  from bytes
), placed as (
  select *, 2 * sum(size) over (order by key, doc_id rows unbounded preceding) - size as middle,
    row_number() over (order by key, doc_id) as place, sum(size) over () as total
  from summed
), dealt as (
  select *, (middle * 16 // (2 * total))::int as shard from placed
)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by place) - 1 as slot, null::int as grown_shard
from dealt
"""


def op4_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_scores(vectors, vectors.where("vec_id % 20 = 0"))


ORACLES["op4_uniform_threshold"] = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
  from scored
)
select * from ranked where rank <= 20
"""


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_rules.measured(docs, "m").select("doc_id", "lang", "m")
    rows = stored(rows, "measured")
    base_failed, kept = quality_rules.verdicts(rows, "m", quality_rules.references(rows, "m"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(
        "doc_id", *[F.col("m")[c].alias(c) for c in counts], base_failed.alias("base_failed"), kept.alias("kept")
    )


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("first").alias("kept"))


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    return fm_quality.scored(docs, model).select(
        "doc_id",
        fm_quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _listed(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def _far(counts: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts, in SQL."""
    share = lambda x: f"({x}[i] / list_sum({x})::double)"
    p, q = share(counts), share(reference)
    half = lambda x: f"(case when {x} > 0 then {x} * log2(2 * {x} / ({p} + {q})) else 0 end)"
    each = f"list_transform(range(1, len({counts}) + 1), lambda i: ({half(p)} + {half(q)}) / 2)"
    return f"sqrt(greatest(list_sum({each}), 0.0))"


_R = quality_rules
_LESS = {k: f"length(s) - length(regexp_replace(s, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for k, p in _R.CLASSES.items()}
ORACLES["op5_distribution_divergence"] = rf"""
with texts as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as s from documents
), words as (
  select *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') as w from texts
), windows as (
  select rid, i, w[i:i + {_R.WINDOW - 1}] as g
  from words, unnest(range(1, len(w) - {_R.WINDOW - 2})) t(i) where len(w) >= {_R.WINDOW}
), twice as (
  select rid, i from (select *, count(*) over (partition by rid, g) as n from windows) where n > 1
), covered as (
  select rid, count(distinct p) as n from twice, unnest(range(i, i + {_R.WINDOW})) t(p) group by rid
), measured as (
  select rid, doc_id, lang, len(w) as n_words, length(s) as n_chars,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(s) - length(regexp_replace(s, '[{_R.SYMBOLS}]+', '', 'g')) as n_symbols,
    list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    {", ".join(f"{x} as {k}" for k, x in _LESS.items())},
    list_transform({_listed(_R.vocabulary())}, lambda x: len(list_filter(w, lambda y: y = x))) as common
  from words
), drawn as (
  select m.*, coalesce(c.n, 0) as n_repeat_words, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    [letters - upper + digits, upper, n_chars - word_chars, points, word_chars - letters - digits - points] as c,
    list_append(common, greatest(n_words - list_sum(common), 0)) as v
  from measured m left join covered c using (rid)
), fit as (
  select * from drawn
  where lang in ({", ".join(f"'{x}'" for x in _R.COMMON_WORDS)})
    and n_words >= {_R.MIN_WORDS} and 100 * n_symbols <= n_chars and 5 * upper <= letters
), refs as (
  select a.lang, a.c, b.v
  from (select lang, list(x order by i) as c from
      (select lang, i, sum(c[i]) as x from fit, range(1, 6) t(i) group by all) group by lang) a
  join (select lang, list(x order by i) as v from
      (select lang, i, sum(v[i]) as x from fit, range(1, {len(_R.vocabulary()) + 2}) t(i) group by all) group by lang) b using (lang)
  where a.lang in (select lang from fit group by lang having count(*) >= {_R.REFERENCE_DOCS})
), compared as (
  select d.rid, min(case when d.n_chars >= {_R.GUARD_CHARS} then {_far("d.c", "r.c")} else 0 end) as of_chars,
    min(case when d.n_words >= {_R.GUARD_WORDS} then {_far("d.v", "r.v")} else 0 end) as of_words
  from drawn d, refs r group by d.rid
), judged as (
  select *, n_words < {_R.MIN_WORDS} or 100 * n_repeat_words > {_R.MAX_REPEAT_PERCENT} * n_words as base_failed
  from drawn left join compared using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(of_chars, 0) <= {_R.MAX_CHAR_DISTANCE} and coalesce(of_words, 0) <= {_R.MAX_WORD_DISTANCE} as kept
from judged
"""


def op7_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op8_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"))


def op9_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.conversations(quote_links.as_mails(table(spark, sf_dir, "conversations")))


#: Bodies are the texts that the mails were made from; lines are paired by brute force.
ORACLES["op9_quotation_links"] = r"""
with recursive said as (
  select conv_id, turn, min(coalesce(text, '')) as said from conversations group by all
), mails as (
  select c.conv_id, c.turn, c.role, coalesce(c.text, '') as body,
    a.said as first, b.said as second
  from conversations c
  left join said a on a.conv_id = c.conv_id and a.turn = c.turn - (case when c.turn % 3 = 0 then 2 else 1 end)
  left join said b on b.conv_id = a.conv_id and b.turn = a.turn - (case when a.turn % 3 = 0 then 2 else 1 end)
), own as (
  select distinct conv_id, turn, lower(trim(regexp_replace(l, '\s+', ' ', 'g'))) as l
  from mails, unnest(string_split(body, chr(10))) t(l)
), quoted as (
  select distinct conv_id, turn, 1 as level, lower(trim(regexp_replace(l, '\s+', ' ', 'g'))) as l
  from mails, unnest(string_split(first, chr(10))) t(l) where first is not null
  union all
  select distinct conv_id, turn, 2, lower(trim(regexp_replace(l, '\s+', ' ', 'g')))
  from mails, unnest(string_split(second, chr(10))) t(l) where second is not null
), votes as (
  select q.conv_id, q.turn, q.level, q.l, max(o.turn) as found
  from quoted q join own o on o.conv_id = q.conv_id and o.l = q.l and o.turn < q.turn
  where q.l <> '' group by all
), replies as (
  select conv_id, turn, arg_max(found, (-level, n, found)) as reply_to
  from (select conv_id, turn, level, found, count(*) as n from votes group by all) group by all
), nodes as (
  select s.conv_id, s.turn, r.reply_to from said s left join replies r using (conv_id, turn)
), threads as (
  select conv_id, turn, turn as root, 0::bigint as depth from nodes where reply_to is null
  union all
  select n.conv_id, n.turn, t.root, t.depth + 1
  from threads t join nodes n on n.conv_id = t.conv_id and n.reply_to = t.turn
), placed as (
  select t.*, n.reply_to, row_number() over (partition by t.conv_id order by root, depth, t.turn) - 1 as position
  from threads t join nodes n using (conv_id, turn)
)
select m.conv_id, m.turn, m.role, p.reply_to, p.root, p.depth, p.position,
  (coalesce(len(string_split(first, chr(10))), 0) + coalesce(len(string_split(second, chr(10))), 0))::int as quoted,
  (case when second is not null then 2 when first is not null then 1 else 0 end)::int as levels, m.body
from mails m join placed p using (conv_id, turn)
"""


#: Personal data that the query takes out of texts.
MASKS = {
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}": "<mail>",
    r"https?://[^ \t\n]+": "<link>",
    r"[0-9][0-9 ()-]{6,}[0-9]": "<number>",
}


def op10_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edit_counts.masks(table(spark, sf_dir, "documents"), MASKS)
    counted = edit_counts.updated(edit_counts.trees(docs), F.col("edits"))
    return counted.select(
        "doc_id",
        F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"),
        *[F.col("counted")[c].alias(c) for c in ("tokens_before", "tokens", "leaves", "leaves_encoded", "chars_encoded")],
    )


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op11_dual_tree"] = f"""
with items as (
  select row, item_id, unnest(list_distinct({_TERMS})) as term from (select row_number() over () as row, * from benchmark)
), words as (
  select doc, doc_id, unnest({_TERMS}) as term from (select row_number() over () as doc, * from documents)
), lengths as (
  select doc, doc_id, count(*) as n from words group by all
), totals as (
  select count(*) as docs, sum(n)::bigint as length from lengths
), sized as (
  select doc, doc_id, 100 - 90 + (90 * n * docs) // length as m from lengths, totals
), counts as (
  select doc, term, count(*) as tf from words where term in (select term from items) group by all
), weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::double))::bigint as w
  from counts, totals group by term
), scored as (
  select row, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from items join counts using (term) join weights using (term) join sized using (doc) group by all
), ranked as (
  select *, row_number() over (partition by row order by score desc, doc_id nulls last)::int as rank from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


def op12_cholesky_jacobi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{working_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_best_fit": op1_best_fit,
    "op2_weighted_minhash": op2_weighted_minhash,
    "op3_factorisation_machine": op3_factorisation_machine,
    "op4_uniform_threshold": op4_uniform_threshold,
    "op5_distribution_divergence": op5_distribution_divergence,
    "op6_sampled_splitters": op6_sampled_splitters,
    "op7_induced_suffixes": op7_induced_suffixes,
    "op8_backtracking_bpe": op8_backtracking_bpe,
    "op9_quotation_links": op9_quotation_links,
    "op10_edit_aware_counts": op10_edit_aware_counts,
    "op11_dual_tree": op11_dual_tree,
    "op12_cholesky_jacobi": op12_cholesky_jacobi,
    "op13_seekable_frames": op13_seekable_frames,
}
