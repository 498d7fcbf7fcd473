"""Selection whose cost is that of the rendering: what must stay, then by rank whatever still fits, then the marker for rows left out.

Candidates are (source_id, candidate_id, kind, text, mandatory, structural, anomaly, protected, first, last, row_index): `first`
and `last` are where a candidate begins and ends in its source, row_index numbers a record (null for others). The rendering
is the chosen texts in the order of their places, one a line; its cost is its length in UTF-8 bytes, which adds up, so a
choice holds costs and ranks of one source only, not its texts. Taking one candidate never rules out a later, smaller one.
Leaving out records adds a line that names them as ranges; what was ranked last goes until the text with that line fits.

Equal candidate ids of one source are kept apart by their places; null flags count as false; a null text is an empty line.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import ORDER_ITEMS_SQL, order_items

OMITTED = "@omitted_rows="
PLACES = ("first", "last", "kind", "candidate_id", "text")
_SIZE = "sum(octet_length(text) + 1) - 1"
_OUT = "struct<states: array<string>, marker: string, cost: bigint, floor: bigint, fits: boolean>"


class Ranges:
    """A set of numbers as the text 1-3,7, with its length kept up to date number by number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.size = -1

    @staticmethod
    def _shown(a: int, b: int) -> int:
        return len(str(a)) + (1 + len(str(b)) if b > a else 0)

    def add(self, x: int) -> None:
        i = bisect.bisect_right(self.starts, x) - 1
        if i >= 0 and x <= self.ends[i]:
            return
        a = b = x
        if i >= 0 and self.ends[i] == x - 1:
            a = self.starts.pop(i)
            self.size -= self._shown(a, self.ends.pop(i)) + 1
            i -= 1
        if i + 1 < len(self.starts) and self.starts[i + 1] == x + 1:
            b = self.ends.pop(i + 1)
            self.size -= self._shown(self.starts.pop(i + 1), b) + 1
        self.starts.insert(i + 1, a)
        self.ends.insert(i + 1, b)
        self.size += self._shown(a, b) + 1

    def __str__(self) -> str:
        return ",".join(str(a) if a == b else f"{a}-{b}" for a, b in zip(self.starts, self.ends, strict=True))


def fitted(cost: np.ndarray, mandatory: np.ndarray, row: np.ndarray, budget: int) -> tuple[list[str], str | None, int, int, bool]:
    """States of one source's candidates in the order of their rank, the marker, the cost of all, the floor, and whether they fit.

    `row` is -1 for what is no record. A candidate is mandatory, taken, skipped (it didn't fit), or dropped for the marker.
    """
    state = ["mandatory" if m else "skipped" for m in mandatory]
    lines = int(mandatory.sum())
    floor = used = int(cost[mandatory].sum()) + max(0, lines - 1)
    order = np.flatnonzero(~mandatory)
    if floor > budget:
        return state, None, floor, floor, False
    taken = []
    for i in order:
        more = int(cost[i]) + (lines > 0)
        if used + more <= budget:
            used, lines = used + more, lines + 1
            state[i] = "taken"
            taken.append(int(i))
    left = Ranges()
    for i in order:
        if state[i] == "skipped" and row[i] >= 0:
            left.add(int(row[i]))

    def with_marker(cost_of_lines: int, n: int) -> int:
        return cost_of_lines + (len(OMITTED) + left.size + (n > 0) if left.starts else 0)

    while with_marker(used, lines) > budget and taken:
        i = taken.pop()
        used, lines = used - int(cost[i]) - (lines > 1), lines - 1
        state[i] = "dropped"
        if row[i] >= 0:
            left.add(int(row[i]))
    total = with_marker(used, lines)
    return state, f"{OMITTED}{left}" if left.starts else None, total, with_marker(floor, int(mandatory.sum())), total <= budget


def _standing(of: Callable[[str], Column] = F.col) -> tuple[Column, Column, Column]:
    flag = lambda c: F.coalesce(of(c), F.lit(False))
    return F.when(flag("mandatory"), 0).when(flag("structural"), 1).otherwise(2), (~flag("anomaly")).cast("int"), (~flag("protected")).cast("int")


def ranked(candidates: DataFrame) -> DataFrame:
    """candidates with `rank` within their source: what is mandatory or structural, anomalies, what protects something, then by place."""
    order = Window.partitionBy("source_id").orderBy(*_standing(), *PLACES)
    return candidates.withColumn("rank", F.row_number().over(order).cast("long"))


def _choose(candidates: pa.Array, budgets: pa.Array) -> pa.Array:
    """States, marker, cost, floor and fits for each row's list of (cost, mandatory, row_index), which is in the order of ranks."""
    flat = candidates.flatten()
    cost, mandatory, row = (flat.field(i).to_numpy(zero_copy_only=False).astype(kind) for i, kind in enumerate((np.int64, bool, np.int64)))
    ends = np.concatenate([[0], np.cumsum(candidates.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
    made = [fitted(cost[a:b], mandatory[a:b], row[a:b], budget) for a, b, budget in zip(ends[:-1].tolist(), ends[1:].tolist(), budgets.to_pylist(), strict=True)]
    states = pa.ListArray.from_arrays(pa.array(ends), pa.array([x for m in made for x in m[0]], pa.string()))
    rest = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_()), 1)]
    return pa.StructArray.from_arrays([states, *rest], ["states", "marker", "cost", "floor", "fits"])


def ranked_entry(columns: list[str], of: Callable[[str], Column] = F.col) -> Column:
    """A candidate with these columns as a struct that sorts by rank."""
    others = [c for c in columns if c not in ("source_id", *PLACES)]
    return F.struct(*[c.alias(f"_{i}") for i, c in enumerate(_standing(of))], *[of(c).alias(c) for c in (*PLACES, *others)])


def stays(z: Column) -> Column:
    return z["state"].isin("mandatory", "taken")


def settled(held: DataFrame) -> DataFrame:
    """held, with a source's candidates in the order of their rank (c) and its budget, and what is chosen of them: states, marker,
    cost, floor and fits (r), candidates with their states (z), and the text."""
    size = lambda c: F.octet_length(F.coalesce(c["text"], F.lit(""))).cast("long")
    sent = F.transform("c", lambda c: F.struct(size(c).alias("cost"), F.coalesce(c["mandatory"], F.lit(False)).alias("mandatory"), F.coalesce(c["row_index"], F.lit(-1)).cast("long").alias("row_index")))
    choose = F.arrow_udf(lambda listed, budget: _choose(listed, budget), _OUT)
    made = held.withColumn("r", choose(sent, F.col("budget").cast("long"))).withColumn("z", F.arrays_zip("c", F.col("r.states").alias("state")))
    kind = lambda c: held.schema["c"].dataType.elementType[c].dataType.simpleString()
    line = lambda first, last, kind, rank, text: F.struct(first.alias("first"), last.alias("last"), kind.alias("kind"), rank.cast("long").alias("rank"), text.alias("text"))
    ranks = F.transform("z", lambda z, i: F.struct(z.alias("z"), (i + 1).alias("rank")))
    lines = F.transform(F.filter(ranks, lambda x: stays(x["z"])), lambda x: line(x["z"]["c"]["first"], x["z"]["c"]["last"], x["z"]["c"]["kind"], x["rank"], F.coalesce(x["z"]["c"]["text"], F.lit(""))))
    gone = F.transform(F.filter("z", lambda z: ~stays(z) & z["c"]["row_index"].isNotNull()), lambda z: F.struct(z["c"]["first"].alias("first"), z["c"]["last"].alias("last")))
    place, marker = F.array_min(gone), F.col("r.marker")
    mark = F.when(marker.isNotNull(), F.array(line(place["first"], place["last"], F.lit(""), F.lit(0), marker))).otherwise(F.array().cast(f"array<struct<first:{kind('first')},last:{kind('last')},kind:string,rank:bigint,text:string>>"))
    text = F.array_join(F.transform(F.array_sort(F.concat(lines, mark)), lambda x: x["text"]), "\n")
    return made.withColumn("text", text)


def _share(size: Column, share: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size * share / 100)).cast("long")


def selected(candidates: DataFrame, budgets: DataFrame | Column) -> tuple[DataFrame, DataFrame]:
    """(choices, sources): every candidate with rank and state; per source of `budgets` (source_id, budget) the text, its cost,
    the cost of what must stay with the marker (floor), the marker and whether the text fits. A source's candidates are one
    row; of these only costs and flags go to Python, many sources at once. A column in place of the budgets is a share as in
    share_of, of which the budget is made where the candidates lie."""
    entry = ranked_entry(candidates.columns)
    held = candidates.groupBy("source_id").agg(F.sort_array(F.collect_list(entry)).alias("c"), F.expr(_SIZE).alias("n"))
    held = held.withColumn("budget", _share(F.col("n"), budgets)) if isinstance(budgets, Column) else held.join(budgets.select("source_id", "budget"), "source_id")
    made = settled(held)
    choices = made.select("source_id", F.posexplode("z").alias("i", "z")).select("source_id", *[F.col(f"z.c.{c}").alias(c) for c in candidates.columns if c != "source_id"], (F.col("i") + 1).cast("long").alias("rank"), "z.state")
    return choices, made.select("source_id", "r.marker", "r.cost", "r.floor", "r.fits", "text")


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's items as candidates: a header that must stay, records, of which failed first items must stay too; those with
    a trace protect something, every fifth is an anomaly."""
    items = order_items(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    head = F.expr("struct('head' as candidate_id, 'json_schema' as kind, concat('@rows=', n) as text, true as mandatory, true as structural, false as anomaly, false as protected, cast(0 as bigint) as first, cast(0 as bigint) as last, cast(null as bigint) as row_index)")
    row = F.expr("struct(concat('row:', nth) as candidate_id, 'json_row' as kind, item as text, nth = 1 and l_returnflag = 'R' as mandatory, false as structural, nth % 5 = 0 as anomaly, nth % 4 = 0 as protected, cast(nth * 1000 as bigint) as first, cast(nth * 1000 + length(item) as bigint) as last, cast(nth - 1 as bigint) as row_index)")
    return items.select(F.col("l_orderkey").alias("source_id"), F.explode(F.when(F.col("nth") == 1, F.array(head, row)).otherwise(F.array(row))).alias("c")).select("source_id", "c.*")


def share_of(candidates: DataFrame, share: Column) -> DataFrame:
    """(source_id, budget): this share, in hundredths, of the cost of all candidates of a source, at least 1."""
    sizes = candidates.groupBy("source_id").agg(F.expr(_SIZE).alias("n"))
    return sizes.select("source_id", _share(F.col("n"), share).alias("budget"))


def rendered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered within a share of their cost that their key decides, with what was left out named."""
    rows = order_candidates(spark, sf_dir)
    _, sources = selected(rows, share_of(rows, F.expr("30 + 10 * (source_id % 7)")))
    return sources.select("source_id", "cost", "floor", "fits", "marker", F.sha2("text", 256).alias("digest"))


def selection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_candidates(spark, sf_dir)
    return selected(rows, share_of(rows, F.expr("30 + 10 * (source_id % 7)")))[0].select("source_id", "candidate_id", "rank", "state")


# A recursion per order: g takes rows by rank, d drops the last taken while the text with its marker is too long.
_M = "array_to_string(list_transform(list_filter(X, lambda x: not list_contains(X, x - 1)), lambda x: x || case when list_contains(X, x + 1) then '-' || list_min(list_filter(X, lambda y: y >= x and not list_contains(X, y + 1))) else '' end), ',')"
_S = (
    ORDER_ITEMS_SQL.replace("with l as", "with recursive l as", 1)
    + """, n as (select k, nth, item, strlen(item) as c, nth = 1 and failed as must, nth % 5 = 0 as odd, nth % 4 = 0 as prot from i),
    s as (select k, max(nth) as m, strlen('@rows=' || max(nth)) as h, sum(c + 1) + strlen('@rows=' || max(nth)) as total, coalesce(sum(case when must then c + 1 end), 0) + strlen('@rows=' || max(nth)) as floor, greatest(1, floor((sum(c + 1) + strlen('@rows=' || max(nth))) * (30 + 10 * (k % 7)) / 100))::bigint as budget, bool_or(must) as has from n group by 1),
    o as (select *, row_number() over (partition by k order by not odd, not prot, nth) as r from n where not must),
    g as (select k, 0::bigint as r, floor as used, []::bigint[] as t, []::bigint[] as a from s where floor <= budget union all select g.k, o.r, case when used + c + 1 <= budget then used + c + 1 else used end, case when used + c + 1 <= budget then list_append(t, nth) else t end, list_append(a, nth) from g join o on o.k = g.k and o.r = g.r + 1 join s on s.k = g.k),
    e as (select * from g qualify row_number() over (partition by k order by r desc) = 1),
    d as (select k, used, t, a, list_sort(list_transform(list_filter(a, lambda x: not list_contains(t, x)), lambda x: x - 1)) as om from e
        union all select d.k, used - c - 1, t[: len(t) - 1], a, list_sort(list_transform(list_filter(a, lambda x: not list_contains(t[: len(t) - 1], x)), lambda x: x - 1)) from d join s on s.k = d.k join n on n.k = d.k and n.nth = t[len(t)] where len(t) > 0 and used + case when len(om) > 0 then 15 + strlen(MARK) else 0 end > budget),
    z as (select *, case when len(om) > 0 then '@omitted_rows=' || MARK end as marker from d qualify row_number() over (partition by k order by len(t)) = 1),
    y as (select s.*, z.t, z.om, z.marker, z.k is not null as ok, case when z.k is null then floor else used + coalesce(strlen(marker) + 1, 0) end as cost from s left join z on z.k = s.k),
    q as (select y.k, n.nth * 1000 as p, item as text from y join n on n.k = y.k where must or list_contains(t, nth) union all select k, 0, '@rows=' || m from y union all select k, (om[1] + 1) * 1000 - 1, marker from y where marker is not null)""".replace("MARK", _M.replace("X", "om"))
)
SQL = {
    "rendered_selection": _S + " select y.k as source_id, cost::bigint as cost, (floor + case when ok then coalesce(strlen(marker) + 1, 0) else 0 end)::bigint as floor, ok and cost <= budget as fits, marker, sha256((select string_agg(text, chr(10) order by p) from q where q.k = y.k)) as digest from y",
    "selection_states": _S + """ select y.k as source_id, 'row:' || n.nth as candidate_id, 1 + row_number() over (partition by n.k order by not must, not odd, not prot, n.nth) as rank, case when must then 'mandatory' when list_contains(y.t, n.nth) then 'taken' when list_contains(e.t, n.nth) then 'dropped' else 'skipped' end as state from y join n on n.k = y.k left join (select k, t from e) e on e.k = y.k
        union all select k, 'head', 1, 'mandatory' from y""",
}
