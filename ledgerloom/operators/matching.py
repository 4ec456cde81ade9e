"""Candidate generation, scoring and one-to-one assignment as DataFrame programs.

Candidates come from an equi join: exact keys, and a cell of band numbers for the narrowest band, entered in three
cells on the target side. Assignment is greedy by source order; as all targets prefer the
earlier source it is the one stable matching, found by taking locally dominant pairs until none is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import SCORERS
from ledgerloom.operators.graph import components
from ledgerloom.plans.rules import Key, Rule, ordered
from ledgerloom.session import ensure_checkpoint_dir

#: Rounds of dominant pairs before what is left is settled by connected components.
ROUNDS = 12
#: Edges of a component that one task may settle; larger ones go on in rounds.
COMPONENT_EDGES = 200_000

Scorers = dict[str, Callable[[Column, Column], Column]]


def bucket(amount: Column, key: Key) -> Column:
    """The number of an amount's band, halves away from zero."""
    if key.steps is not None:
        return F.signum(amount).cast("long") * key.steps
    width = 2 * key.amount if key.amount else 1
    return F.round(amount / F.lit(str(width)).cast("decimal(20,4)"), 0).cast("long")


def field(side: str, name: str) -> Column:
    """A record's field; ``extra.x`` is an entry of its map."""
    return F.col(f"{side}.extra").getItem(name.removeprefix("extra.")) if name.startswith("extra.") else F.col(f"{side}.{name}")


def _both(name: str) -> tuple[Column, Column]:
    return field("s", name), field("t", name)


def condition(key: Key) -> Column:
    """When two records may meet by a key; missing values meet each other."""
    a, b = _both(key.field)
    if key.kind == "exact":
        return a.eqNullSafe(b)
    gap = F.datediff(a, b) if key.kind == "date_window" else bucket(a, key) - bucket(b, key)
    return F.coalesce(F.abs(gap) <= (2 * key.days if key.kind == "date_window" else 2), a.isNull() & b.isNull())


def rank(key: Key) -> Column:
    """The order in which a key's candidates are visited, which breaks ties."""
    a, b = _both(key.field)
    if key.kind == "exact":
        return F.lit(0)
    gap = F.datediff(b, a) if key.kind == "date_window" else bucket(b, key) - bucket(a, key)
    return F.coalesce(F.greatest(F.lit(0), gap), F.lit(0))


def _cell(side: str, key: Key) -> Column:
    """Cells so wide that records that may meet are in the same or in neighbouring ones."""
    if key.kind == "date_window":
        return F.floor(F.unix_date(field(side, key.field)) / (2 * key.days + 1))
    return F.floor(bucket(field(side, key.field), key) / 3)


def candidates(source: DataFrame, target: DataFrame, keys: tuple[Key, ...]) -> DataFrame:
    """Pairs with the records under ``s`` and ``t``."""
    bands = sorted((k for k in keys if k.kind != "exact"), key=lambda k: (k.steps is not None, k.kind != "numeric"))
    s, t = source.alias("s"), target.alias("t")
    on = [condition(k) for k in keys]
    if bands:
        s = s.withColumn("cell", _cell("s", bands[0]))
        cell = _cell("t", bands[0])
        t = t.withColumn("cell", F.explode(F.when(cell.isNull(), F.array(cell)).otherwise(F.array(cell - 1, cell, cell + 1))))
        on.insert(0, s["cell"].eqNullSafe(t["cell"]))
    whole = on[0]
    for c in on[1:]:
        whole = whole & c
    return s.join(t, whole)


def field_scores(rule: Rule, scorers: Scorers = SCORERS) -> list[Column]:
    """Each field's score, 0 below its least similarity; a missing value is an error, as a score of it has no meaning."""
    out = []
    for s in rule.scores:
        a, b = _both(s.field)
        one = scorers[s.method](a, b)
        if s.field.startswith("extra."):
            one = F.when(a.isNull() | b.isNull(), F.raise_error(F.lit(f"{s.field} is missing")).cast("double")).otherwise(one)
        out.append(F.when(one < s.least, 0.0).otherwise(one) if s.least > 0 else one)
    return out


def scored(pairs: DataFrame, rule: Rule, scorers: Scorers = SCORERS, breakdown: bool = False) -> DataFrame:
    """``src_ord, src_id, tgt_ord, tgt_id, score, ranks`` of the pairs that reach the suggestion threshold; with the
    scores by field as ``field_scores`` where asked for (a repeated field keeps its last one)."""
    total = sum((F.coalesce(one, F.lit(0.0)) * s.weight for one, s in zip(field_scores(rule, scorers), rule.scores, strict=True)), F.lit(0.0))
    ranks = [rank(k).cast("long") for k in rule.keys]
    columns = [F.col("s.ord").alias("src_ord"), F.col("s.id").alias("src_id"), F.col("t.ord").alias("tgt_ord"), F.col("t.id").alias("tgt_id"), F.round(total, 9).alias("score"), F.array(*ranks).alias("ranks")]
    if breakdown:
        last = {s.field: one for one, s in zip(field_scores(rule, scorers), rule.scores, strict=True)}
        columns.append(F.create_map(*[x for name, one in last.items() for x in (F.lit(name), F.coalesce(one, F.lit(0.0)))]).alias("field_scores"))
    return pairs.select(*columns).where(F.col("score") >= rule.suggest)


def best_candidate(edges: DataFrame) -> DataFrame:
    """The first choice of each source, without regard to others; an aggregate, which combines before its shuffle."""
    others = [c for c in edges.columns if c not in ("src_ord", "score", "ranks", "tgt_ord", "field_scores")]
    choice = F.min(F.struct((-F.col("score")).alias("less"), "ranks", "tgt_ord", *others)).alias("c")
    best = edges.groupBy("src_ord").agg(choice)
    return best.select("src_ord", *[F.col(f"c.{c}").alias(c) for c in others], "c.tgt_ord", (-F.col("c.less")).alias("score"), "c.ranks")


def classify(score: Column, rule: Rule) -> Column:
    return F.when(score >= rule.auto, "AUTO").when(score >= rule.suggest, "SUGGESTED")


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one component: sources in order, each with its best free target."""
    key = list(zip(frame["src_ord"], -frame["score"], map(tuple, frame["ranks"]), frame["tgt_ord"], strict=True))
    taken, done, keep = set(), set(), []
    for at in sorted(range(len(key)), key=key.__getitem__):
        s, _, _, t = key[at]
        if s not in done and t not in taken:
            done.add(s)
            taken.add(t)
            keep.append(at)
    return frame.iloc[keep].drop(columns="component")


def assign(edges: DataFrame, rounds: int = ROUNDS, component_edges: int = COMPONENT_EDGES) -> DataFrame:
    """One-to-one pairs: each source in order takes its best target that no earlier one has taken.

    A round accepts the pairs that are first for both sides among the edges left, and drops the edges of what
    it took, cut to the checkpoint folder. Chains of contention take a round a link, so after ``rounds`` the edges left are
    parted by connected component and each component is settled in order by one task; only components of
    more than ``component_edges`` edges go on in rounds.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    columns = [c for c in edges.columns if c != "field_scores"]
    left, taken, since = edges.select(*columns).checkpoint(), [], 0
    while not left.isEmpty():
        if since >= rounds:
            # nodes of both sides in one numbering
            node = left.select("*", (F.col("src_ord") * 2).alias("x"), (F.col("tgt_ord") * 2 + 1).alias("y"))
            found = components(node, "x", "y")
            parted = node.join(found.select(F.col("node").alias("x"), "component"), "x").drop("x", "y").checkpoint()
            small = parted.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= component_edges).select("component")
            schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema.fields)
            taken.append(parted.join(small, "component", "left_semi").select(*columns, "component").groupBy("component").applyInPandas(_settle, schema).checkpoint())
            left = parted.join(small, "component", "left_anti").select(*columns).checkpoint()
            since = 0
            continue
        first = left.groupBy("tgt_ord").agg(F.min("src_ord").alias("src_ord"))
        got = best_candidate(left).join(first, ["src_ord", "tgt_ord"]).select(*columns).checkpoint()
        left = left.join(got.select("src_ord"), "src_ord", "left_anti").join(got.select("tgt_ord"), "tgt_ord", "left_anti").select(*columns).checkpoint()
        taken.append(got)
        since += 1
    out = taken[0] if taken else left
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def match(source: DataFrame, target: DataFrame, rule: Rule, scorers: Scorers = SCORERS) -> DataFrame:
    """``src_ord, tgt_ord, src_id, tgt_id, score, status, rule`` of one rule."""
    pairs = assign(scored(candidates(source, target, rule.keys), rule, scorers))
    return pairs.select("src_ord", "tgt_ord", "src_id", "tgt_id", "score", classify(F.col("score"), rule).alias("status"), F.lit(rule.name).alias("rule"))


def match_chain(source: DataFrame, target: DataFrame, rules: list[Rule], scorers: Scorers = SCORERS) -> DataFrame:
    """Rules by priority, each on what the earlier ones left; both kinds of match take their records."""
    done = None
    for rule in ordered(rules):
        found = match(source, target, rule, scorers)
        source = source.join(found.select(F.col("src_ord").alias("ord")), "ord", "left_anti")
        target = target.join(found.select(F.col("tgt_ord").alias("ord")), "ord", "left_anti")
        done = found if done is None else done.unionByName(found)
    if done is None:
        raise ValueError("no rules")
    return done


def unmatched(source: DataFrame, target: DataFrame, matches: DataFrame) -> DataFrame:
    """What no match took, of both sides."""
    s = source.join(matches.select(F.col("src_ord").alias("ord")), "ord", "left_anti").withColumn("side", F.lit("SOURCE"))
    t = target.join(matches.select(F.col("tgt_ord").alias("ord")), "ord", "left_anti").withColumn("side", F.lit("TARGET"))
    return s.unionByName(t)


# ---------------------------------------------------------------- results, lines and breaks
def results(matches: DataFrame, source: DataFrame, target: DataFrame, provisional: bool = False) -> tuple[DataFrame, DataFrame]:
    """Match results ``result_id, rule, status, score`` and their lines ``result_id, transaction_id, side, allocated_amount``.

    A stream's results are provisional: AUTO becomes AUTO_MATCHED_STREAMING, others go, and its lines have no amounts.
    """
    keyed = matches.withColumn("result_id", F.concat("src_id", F.lit(">"), "tgt_id"))
    if provisional:
        keyed = keyed.where("status = 'AUTO'").withColumn("status", F.lit("AUTO_MATCHED_STREAMING"))

    def line(side: str, ledger: DataFrame, key: str) -> DataFrame:
        amount = ledger.select(F.col("ord").alias(f"{key}_ord"), F.col("base_amount").alias("allocated_amount"))
        out = keyed.join(amount, f"{key}_ord").select("result_id", F.col(f"{key}_id").alias("transaction_id"), F.lit(side).alias("side"), "allocated_amount")
        return out.withColumn("allocated_amount", F.lit("0").cast("decimal(20,4)")) if provisional else out

    return keyed.select("result_id", "rule", "status", "score"), line("SOURCE", source, "src").unionByName(line("TARGET", target, "tgt"))


def with_status(ledger: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """A ledger's records after the matches: AUTO ones are MATCHED, suggested ones stay UNMATCHED."""
    auto = matches.where("status = 'AUTO'").select(F.col(f"{side}_ord").alias("ord"), F.lit("MATCHED").alias("new"))
    return ledger.join(auto, "ord", "left").withColumn("status", F.coalesce("new", F.lit("UNMATCHED"))).drop("new")


def breaks(left: DataFrame) -> DataFrame:
    """A break for each record that is left, once for each record and kind."""
    return left.dropDuplicates(["id"]).select(
        F.concat(F.lit("BREAK-"), "id").alias("id"), F.col("id").alias("transaction_id"), F.lit("UNMATCHED").alias("break_type"), F.lit("OPEN").alias("status"), F.col("base_amount").alias("amount_at_risk"),
    )


def outcome_counts(matches: DataFrame, left: DataFrame) -> DataFrame:
    """``rule, status, n`` of matches, and the number of unmatched records, each of which opens a break."""
    none = left.groupBy().agg(F.count("*").alias("n")).select(F.lit("").alias("rule"), F.lit("UNMATCHED").alias("status"), "n")
    return matches.groupBy("rule", "status").agg(F.count("*").alias("n")).unionByName(none)


# ---------------------------------------------------------------- groups
def _first_group(amounts: list[int], want: int, slack: float, most: int) -> list[int]:
    """The first combination in order of size and places whose sum is near enough, or none.

    Sums of the last place are looked up instead of tried, so a size costs one power of the candidates less.
    """
    from bisect import bisect_left
    from itertools import combinations

    for size in range(1, min(most, len(amounts)) + 1):
        order = sorted(range(len(amounts)), key=lambda i: (amounts[i], i))
        sums = [amounts[i] for i in order]
        for head in combinations(range(len(amounts)), size - 1):
            rest = want - sum(amounts[i] for i in head)
            last = None
            at = bisect_left(sums, rest - slack)
            while at < len(sums) and sums[at] <= rest + slack:
                if (not head or order[at] > head[-1]) and (last is None or order[at] < last):
                    last = order[at]
                at += 1
            if last is not None:
                return [*head, last]
    return []


def find_groups(lines: DataFrame, wanted: DataFrame, absolute: str = "0", percent: str = "0", most: int = 5) -> DataFrame:
    """``key, places``: for each wanted (key, amount) the first group of (key, place, amount) whose sum is near it.

    Sizes 1 to ``most`` are tried in turn, each in the order of places. An absolute tolerance is used before a
    percentage of the wanted amount; with neither the sum must be equal. A key without a group has none (null).
    A key's candidates meet in one task, as blocking has made them few.
    """
    from decimal import Decimal

    from ledgerloom.plans.rules import MAX_GROUP

    most = most if 0 < most <= MAX_GROUP else MAX_GROUP
    unit = Decimal("10000")
    flat, share = int(Decimal(absolute) * unit), Decimal(percent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for want, listed in zip(frame["want"], frame["amounts"], strict=True):
                slack = flat if flat else float(abs(want) * share) if share else 0
                out.append(_first_group([int(x) for x in listed], int(want), slack, most))
            found = [[int(frame["places"].iloc[i][p]) for p in g] if g else None for i, g in enumerate(out)]
            yield pd.DataFrame({"key": frame["key"], "places": found})

    whole = lambda c: (F.col(c) * 10000).cast("long")
    held = lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", whole("amount").alias("a")))).alias("held"))
    rows = wanted.select("key", whole("amount").alias("want")).join(held, "key", "left")
    empty = F.array().cast("array<long>")
    rows = rows.select("key", "want", F.coalesce(F.col("held.place").cast("array<long>"), empty).alias("places"), F.coalesce("held.a", empty).alias("amounts"))
    kind = lines.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, places array<long>")
