"""The full report: every analysis of one set of entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from logweir.functions import predicates as P, times
from logweir.functions.times import iso_text
from logweir.operators import correlation, detections, geo, overview, temporal, topn
from logweir.operators.facts import all_facts, facts_of, regroup
from logweir.plans.shared import settled

#: The report as one nested record: figures, rankings, and at most a few anomalies a kind.
#: Lists that grow with the data (suspects, spikes, hours, correlations, places) are rows.
REPORT_DDL = (
    "meta struct<total: bigint, errors: bigint, warnings: bigint, error_rate: double, "
    "start_time: string, end_time: string, sources: array<string>>, "
    "top_ips array<struct<ip: string, count: bigint>>, "
    "top_error_ips array<struct<ip: string, count: bigint>>, "
    "top_paths array<struct<path: string, count: bigint>>, "
    "top_status_codes array<struct<status: int, count: bigint>>, "
    "top_methods array<struct<method: string, count: bigint>>, "
    "top_user_agents array<struct<ua: string, count: bigint>>, "
    "anomalies array<struct<type: string, ip: string, count: bigint, pct: double, "
    "description: string, severity: string>>, "
    "temporal struct<by_hour: map<string, bigint>, by_weekday: map<string, bigint>, "
    "peak_hour: int, peak_weekday: string>, "
    "banned_ips array<struct<ip: string, count: bigint>>"
)

# How many rows of a list each report page shows, and its short form.
PAGE_ROWS = {
    "spike_windows": 5,
    "top_status_codes": 8,
    "top_methods": 6,
    "top_paths": 15,
    "geo": 20,
}
SHORT_PAGE_ROWS = {**PAGE_ROWS, "top_paths": 10, "geo": 15}

#: Sort keys of a list as columns that all lists have: numbers first, then texts.
_KEYS = ["number1", "number2", "text1", "text2"]
ROWS_SCHEMA = "section string, position bigint, item string"


@dataclass(frozen=True)
class Section:
    """A list of the report and the order of its rows, as ascending sort keys."""

    rows: DataFrame
    order: tuple[Column, ...]


def _largest_first(column: str, *then: str) -> tuple[Column, ...]:
    return (-F.col(column), *map(F.col, then))


def _parsed(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.from_json(x["item"], kind)


class Report:
    """All analyses of ``entries``, each built when it is asked for.

    The entries are read twice: once for the shared aggregates, which are kept
    in the shared folder as soon as a list needs them, and once for the correlation. So let ``entries`` be a
    stored table rather than raw log files. Where the aggregates are at hand (``plans.state``),
    ``facts`` and ``gaps`` take their place and no entries are needed.
    """

    def __init__(
        self,
        entries: DataFrame | None = None,
        top_n: int = 10,
        correlation_window_minutes: float = correlation.WINDOW_MINUTES,
        networks: DataFrame | None = None,
        geo_ips: str = "top",
        facts: DataFrame | None = None,
        gaps: DataFrame | None = None,
    ):
        if entries is None and (facts is None or gaps is None):
            raise ValueError("A report needs entries, or facts and gaps")
        self.entries = entries
        self.top_n = top_n
        self.correlation_window_minutes = correlation_window_minutes
        self.networks = networks
        self.geo_ips = geo_ips
        self._given_facts, self._given_gaps = facts, gaps

    @property
    def spark(self) -> SparkSession:
        return (self._given_facts if self.entries is None else self.entries).sparkSession

    @cached_property
    def _facts(self) -> DataFrame:
        found = self._given_facts if self._given_facts is not None else all_facts(self.entries)
        return settled(found, by="facts")

    def _by(self, name: str) -> DataFrame:
        return facts_of(self._facts, name)

    @cached_property
    def _hours(self) -> DataFrame:
        """One row per calendar hour, and one for entries without a time."""
        return regroup(self._by("hour"), "hour")

    @cached_property
    def meta(self) -> DataFrame:
        """One row: totals, time span, sources."""
        return overview.totals_of_hours(self._by("hour"))

    @cached_property
    def _figures(self) -> Column:
        """The record's ``meta`` and ``temporal`` as one value, from one grouping of the hours.

        Hours are summed by hour of the day and weekday first: at most 169 rows make the value.
        """
        hour = F.col("hour")
        cells = self._by("hour").groupBy(times.hour(hour).alias("hour"), times.weekday(hour).alias("weekday")).agg(
            *(F.sum(c).alias(c) for c in ("total", "level_errors", "warnings")),
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
            F.collect_set("source").alias("sources"),
        )
        whole = cells.agg(
            *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("total", "total"), ("level_errors", "errors"), ("warnings", "warnings"))),
            iso_text(F.min("first_time")).alias("start_time"),
            iso_text(F.max("last_time")).alias("end_time"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
            F.collect_list(F.struct("hour", "weekday", "total")).alias("cells"),
        )

        def counted(keys: Column, field: str, name: str) -> Column:
            def summed(key: Column) -> Column:
                own = F.filter("cells", lambda x: x[field] == key)
                return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x["total"])

            pairs = F.transform(keys, lambda key: F.struct(key.alias("key"), summed(key).alias("count")))
            return F.filter(pairs, lambda p: p["count"] > 0).alias(name)

        names = F.array(*map(F.lit, sorted(times.WEEKDAYS)))
        rows = overview.overview_of(whole).select(
            F.struct("total", "errors", "warnings", "error_rate", "start_time", "end_time", "sources").alias("meta"),
            counted(F.sequence(F.lit(0), F.lit(23)), "hour", "hours"),
            counted(names, "weekday", "days"),
        )
        # Ties go to the first hour, and to the first name.
        hours = F.transform("hours", lambda p: F.struct(p["count"].alias("n"), (-p["key"]).alias("key")))
        days = F.transform("days", lambda p: F.struct((-p["count"]).alias("n"), p["key"].alias("key")))
        temporal_ = F.struct(
            F.map_from_entries("hours").alias("by_hour"),
            F.map_from_entries("days").alias("by_weekday"),
            (-F.array_max(hours)["key"]).alias("peak_hour"),
            F.array_min(days)["key"].alias("peak_weekday"),
        )
        return rows.select(F.struct("meta", temporal_.alias("temporal"))).scalar()

    @cached_property
    def by_hour(self) -> DataFrame:
        return temporal.hours_of_day(self._hours)

    @cached_property
    def by_weekday(self) -> DataFrame:
        return temporal.weekdays_of(self._hours)

    @cached_property
    def peaks(self) -> DataFrame:
        return temporal.peaks(self.by_hour, self.by_weekday)

    @cached_property
    def anomalies(self) -> DataFrame:
        return detections.anomalies_of(self._by("ip"))

    @cached_property
    def brute_force(self) -> DataFrame:
        return detections.brute_force_of(self._by("ip"))

    @cached_property
    def correlations(self) -> DataFrame:
        hours = self._by("hour")
        several = hours.agg(F.min("source") < F.max("source")).scalar()
        gaps = self._given_gaps if self._given_gaps is not None else correlation.closest_gaps(self.entries)
        return settled(correlation.correlations_of(gaps.where(several), self.correlation_window_minutes))

    @cached_property
    def geo(self) -> DataFrame | None:
        if self.networks is None:
            return None
        ips = self._by("ip")
        if self.geo_ips == "top":
            ips = topn.rank(ips, "ip", self.top_n)
            return geo.locate(ips.select("ip"), self.networks)
        return settled(geo.locate(ips.where(P.has("ip")).select("ip"), self.networks))

    def _ranked(self, facts: str, column: str, measure: str = "total", name=None, again=False) -> Section:
        counts = self._by(facts)
        if again:
            counts = regroup(counts, column)
        rows = topn.rank(counts, column, self.top_n, measure)
        if name:
            rows = rows.withColumnRenamed(column, name)
        return Section(rows, _largest_first("count", name or column))

    @cached_property
    def _builders(self) -> dict[str, Callable[[], Section]]:
        """The lists of the report, each built when it is asked for."""
        kinds = F.array(*map(F.lit, ("high_volume_ip", "high_error_rate", "scanner_detected")))
        ranked = self._ranked
        out = {
            "top_ips": lambda: ranked("ip", "ip"),
            "top_error_ips": lambda: ranked("ip", "ip", "level_errors"),
            "top_paths": lambda: ranked("path", "path"),
            "top_status_codes": lambda: ranked("status_method", "status", again=True),
            "top_methods": lambda: ranked("status_method", "method", again=True),
            "top_user_agents": lambda: ranked("user_agent", "user_agent", name="ua"),
            "brute_force": lambda: Section(self.brute_force, _largest_first("count", "ip", "type")),
            "anomalies": lambda: Section(
                self.anomalies,
                (F.array_position(kinds, F.col("type")), *_largest_first("count", "ip")),
            ),
            "spike_windows": lambda: Section(
                temporal.spikes_of(self._hours.where(F.col("hour").isNotNull())),
                _largest_first("errors", "window"),
            ),
            "correlations": lambda: Section(
                self.correlations, (F.col("closest_gap_minutes"), F.col("ip"))
            ),
            "banned_ips": lambda: ranked("ip", "ip", "bans"),
            "timeline": lambda: Section(temporal.timeline_of(self._hours), (F.col("time"),)),
        }
        if self.networks is not None:
            out["geo"] = lambda: Section(self.geo, (F.col("ip"),))
        return out

    def section(self, name: str) -> Section:
        return self._builders[name]()

    def page(self, name: str, rows: int | None = None, short: bool = False) -> DataFrame:
        """The first rows of a list, as many as its report page shows."""
        section = self.section(name)
        shown = SHORT_PAGE_ROWS if short else PAGE_ROWS
        wanted = rows if rows is not None else shown.get(name, self.top_n)
        return section.rows.orderBy(*section.order).limit(wanted)

    @cached_property
    def _all_rows(self) -> DataFrame:
        return self._placed(list(self._builders))

    def rows(self, names: Iterable[str] | None = None) -> DataFrame:
        """All rows of all lists in one table: (section, position, item as JSON text).

        ``position`` counts the rows of a list from 0 in its order.
        """
        return self._all_rows if names is None else self._placed(list(names))

    def _placed(self, names: list[str]) -> DataFrame:
        """The lists' rows with their positions.

        All lists are sorted as one, by ranges of their keys, so that a list of any
        length is spread over tasks; a row's position follows from its place within
        its range and the rows of the ranges before, of which there are few.
        """
        parts = [self._keyed(name) for name in names]
        keyed = settled(reduce(DataFrame.union, parts))
        order = ["section", *_KEYS]
        ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        # The upper bits of this number are the range, the lower ones the place in it.
        numbered = settled(ranged.drop(*_KEYS).withColumn("at", F.monotonically_increasing_id()))
        numbered = numbered.withColumn("range", F.shiftright("at", 33))
        place = F.col("at") - F.shiftleft(F.col("range"), 33)
        # One row for each range and section.
        counts = numbered.groupBy("section", "range").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        before = Window.partitionBy("section").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("section", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        position = F.col("before") + place - F.col("first")
        return numbered.join(starts, ["section", "range"]).select("section", position.alias("position"), "item")

    def _keyed(self, name: str) -> DataFrame:
        """A list's rows as JSON texts with its sort keys in the common columns."""
        section = self.section(name)
        rows = section.rows
        kinds = [f.dataType for f in rows.select(*section.order).schema]
        texts = [k for k, kind in zip(section.order, kinds) if isinstance(kind, StringType)]
        numbers = [k for k, kind in zip(section.order, kinds) if not isinstance(kind, StringType)]
        keys = {f"text{i}": k for i, k in enumerate(texts, 1)} | {f"number{i}": k for i, k in enumerate(numbers, 1)}
        filled = [
            keys.get(c, F.lit(None)).cast("double" if c.startswith("number") else "string").alias(c) for c in _KEYS
        ]
        return rows.select(F.lit(name).alias("section"), *filled, F.to_json(F.struct("*")).alias("item"))

    def document(self, rows: DataFrame | None = None) -> DataFrame:
        """One row with the report's record, as ``REPORT_DDL`` describes it; ``rows`` has the rest.

        Its lists are taken from ``rows``, those of this report or the same as they were stored.
        """
        fields = StructType.fromDDL(REPORT_DDL)
        listed = [f for f in fields if isinstance(f.dataType, ArrayType)]
        # Only lists that do not grow with the data: a few rows each.
        few = (self.rows() if rows is None else rows).where(F.col("section").isin([f.name for f in listed]))
        item = F.struct("position", "item")
        gathered = few.agg(
            *(F.array_sort(F.collect_list(F.when(F.col("section") == f.name, item))).alias(f.name) for f in listed)
        )
        columns = []
        for field in fields:
            if field.name in ("meta", "temporal"):
                value = F.col("figures")[field.name]
            else:
                value = F.transform(field.name, _parsed(field.dataType.elementType.simpleString()))
            columns.append(value.cast(field.dataType).alias(field.name))
        return gathered.withColumn("figures", self._figures).select(*columns)

    def write_json(self, path: str) -> None:
        """The one-record report as a JSON file in ``path``."""
        self.document().coalesce(1).write.mode("overwrite").json(path)

    def write_rows(self, path: str) -> None:
        """Every list in full, as JSON lines in a folder of its own; its order is not kept."""
        self.rows().select("section", "item").write.mode("overwrite").partitionBy("section").text(path)
