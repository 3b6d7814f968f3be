"""Token files: what is written is what is read, and damage is found."""

import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweir.llm import token_files
from logweir.llm.tokens import vocabulary_path
from tests.llm.llm_helpers import documents, nothing, prose, rows


def plain(texts):
    library = Tokenizer.from_file(vocabulary_path())
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_round_trip_of_awkward_rows(spark, tmp_path):
    folder = str(tmp_path / "files")
    token_files.write(documents(spark).repartition(3), folder, file_bytes=20_000, volume_bytes=5_000)
    got = token_files.read(spark, folder).collect()
    expected = sorted((r[0] is None, r[0] or 0, crc(ids), len(ids)) for r, ids in zip(rows(), plain(r[1] for r in rows())))
    assert sorted((r.doc_id is None, r.doc_id or 0, zlib.crc32(bytes(r.ids)), r.n_tokens) for r in got) == expected
    ordered = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is None, r.doc_id or 0) for r in ordered] == [x[:2] for x in expected]
    ends = np.cumsum([r.n_tokens for r in ordered])
    assert [r.start for r in ordered] == [0, *ends[:-1].tolist()]
    listed = token_files.volumes(spark, folder)
    assert listed.count() > 3 and listed.select("file").distinct().count() > 1
    assert listed.agg(F.sum("documents"), F.sum("tokens")).first() == (len(got), int(ends[-1]))


def test_only_what_is_wanted_is_read(spark, tmp_path):
    folder = tmp_path / "files"
    docs = spark.createDataFrame([(i, prose(80, i)) for i in range(60)], "doc_id bigint, text string")
    token_files.write(docs, str(folder), file_bytes=2_000, volume_bytes=600)
    wanted = token_files.read(spark, str(folder), [3, 3, 41, 999])
    everything = {r.doc_id: r for r in token_files.read(spark, str(folder)).collect()}
    assert sorted(r.doc_id for r in wanted.collect()) == [3, 41]
    assert all(r == everything[r.doc_id] for r in wanted.collect())
    # A frame that is not wanted may be damaged; one that is read may not.
    path = Path(token_files.volumes(spark, str(folder)).where("first_id <= 41 and last_id >= 41").first().path.removeprefix("file:"))
    content = path.read_bytes()
    volume = next(v for v in token_files.volumes_of(content) if 41 in v.ids.tolist())
    k = volume.ids.tolist().index(41)
    other = bytearray(content)
    at = int(volume.at[volume.first[k]]) + 12
    other[at] ^= 0xFF
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(bytes(other))
    near = 40 if 40 in volume.ids.tolist() else 42
    assert token_files.read(spark, str(folder), [near]).count() == 1
    with pytest.raises(Exception, match="another content|Error|Damaged"):
        token_files.read(spark, str(folder), [41]).collect()


def test_no_documents(spark, tmp_path):
    folder = str(tmp_path / "files")
    token_files.write(nothing(spark), folder)
    assert token_files.read(spark, folder).collect() == []
    assert token_files.read(spark, folder, [1]).collect() == []


def test_equal_rows_without_id_are_divided(spark, tmp_path):
    """One key holds all rows: the files still have the size that is asked for."""
    folder = str(tmp_path / "files")
    docs = spark.range(400).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(prose(50, 1)).alias("text"))
    token_files.write(docs.repartition(4), folder, file_bytes=4_000)
    sizes = [r.documents for r in token_files.volumes(spark, folder).collect()]
    assert sum(sizes) == 400 and len(sizes) > 5 and max(sizes) < 150
    starts = sorted(r.start for r in token_files.read(spark, folder).collect())
    assert len(set(np.diff(starts).tolist())) == 1


def test_layout():
    """A volume is a series of zstandard frames that any tool reads, with the seek table at the end."""
    r = random.Random(1)
    ids = [[r.randrange(50_000) for _ in range(n)] for n in (1, 5000, 3)]
    compressor = zstandard.ZstdCompressor(level=3)
    frames = [token_files.frames_of(struct.pack(f"<{len(i)}I", *i), 2, compressor, 1024) for i in ids]
    content = token_files.volume_of([(4, *frames[0]), (9, *frames[1]), (None, *frames[2])], 2, 6, 1)
    assert content[-4:] == struct.pack("<I", 0x8F92EAB1)
    reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert np.frombuffer(reader.read(), "<u2").tolist() == sum(ids, [])
    two = token_files.volumes_of(content + content)
    assert [v.begin for v in two] == [0, len(content)]
    volume = two[1]
    assert (volume.file, volume.volume, volume.documents, volume.tokens) == (6, 1, 3, 5004)
    assert volume.starts.tolist()[:3] == [0, 1, 5001] and np.diff(volume.first).tolist() == [1, 5, 1]
    decompressor = zstandard.ZstdDecompressor()
    assert [np.frombuffer(volume.read(k, decompressor), "<u4").tolist() for k in range(3)] == ids
    for broken in (content[:-1], content[:40], content[100:], b"x"):
        with pytest.raises(token_files.Damaged):
            token_files.volumes_of(broken)


def test_ids_beyond_two_bytes():
    ids = [1, 70_000, 2]
    compressor = zstandard.ZstdCompressor()
    entry = token_files.frames_of(struct.pack("<3I", *ids), 4, compressor)
    volume = token_files.Volume(memoryview(token_files.volume_of([(1, *entry)], 4, 0, 0)))
    assert np.frombuffer(volume.read(0, zstandard.ZstdDecompressor()), "<u4").tolist() == ids
