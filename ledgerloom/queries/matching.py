"""Candidates, scores, assignment, groups, reconciliation, review, rules and scans."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import similarity
from ledgerloom.operators import matching, reconcile as reconciling, scans
from ledgerloom.plans import canonical as C
from ledgerloom.plans import rules
from ledgerloom.queries.registry import query
from ledgerloom.session import table


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source = C.source_ledger(spark, sf_dir)
    return source, C.target_ledger(source)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with the target of its own number."""
    s, t = ledgers(spark, sf_dir)
    return s.alias("s").join(t.alias("t"), "ord").select("ord", *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for c in s.columns if c != "ord" for x in "st"])


PAIRS = "FROM src s JOIN tgt t ON s.ord = t.ord"
BUCKET = "CAST(round({0} * 50) AS BIGINT)"
EDGE_FROM = f"""FROM src s JOIN tgt t ON s.tenant_id = t.tenant_id AND s.currency = t.currency AND abs(date_diff('day', s.value_date, t.value_date)) <= 2
    AND abs({BUCKET.format("s.base_amount")} - {BUCKET.format("t.base_amount")}) <= 2"""
NUMERIC = "CASE WHEN abs({0} - {1}) <= 0.01 THEN 1.0 WHEN CAST(abs({0} - {1}) AS DOUBLE) >= 0.02 THEN 0.0 ELSE CAST(1.0 AS DOUBLE) - (CAST(abs({0} - {1}) AS DOUBLE) - CAST(0.01 AS DOUBLE)) / CAST(0.01 AS DOUBLE) END"
LEVENSHTEIN = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1})) END"
DATE = "greatest(CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) - CAST(abs(date_diff('day', {0}, {1})) AS DOUBLE) / 7)"
PARTS = [LEVENSHTEIN.format("s.reference", "t.reference"), f"CAST(({NUMERIC.format('s.base_amount', 't.base_amount')}) AS DOUBLE)", DATE.format("s.value_date", "t.value_date")]
TOTAL = f"round(({PARTS[0]}) * CAST(0.3 AS DOUBLE) + {PARTS[1]} * CAST(0.4 AS DOUBLE) + ({PARTS[2]}) * CAST(0.3 AS DOUBLE), 9)"
EDGES = f"""edges AS MATERIALIZED (SELECT * FROM (SELECT s.ord AS src_ord, t.ord AS tgt_ord, {TOTAL} AS score,
    greatest(0, date_diff('day', s.value_date, t.value_date)) AS r2, greatest(0, {BUCKET.format("t.base_amount")} - {BUCKET.format("s.base_amount")}) AS r3 {EDGE_FROM}) WHERE score >= 0.6)"""


def greedy_sql(name: str, edges: str) -> str:
    """Rounds of dominant pairs over ``edges`` until no edge is left; the pairs are in the CTE ``name``."""
    return f"""{name}_r AS (SELECT src_ord, tgt_ord, score, r2, r3, false AS done FROM {edges}
    UNION ALL SELECT src_ord, tgt_ord, score, r2, r3, hit FROM (
        SELECT *, bool_or(hit) OVER (PARTITION BY src_ord) AS hs, bool_or(hit) OVER (PARTITION BY tgt_ord) AS ht FROM (
            SELECT *, row_number() OVER (PARTITION BY src_ord ORDER BY score DESC, r2, r3, tgt_ord) = 1 AND min(src_ord) OVER (PARTITION BY tgt_ord) = src_ord AS hit FROM {name}_r WHERE NOT done))
    WHERE hit OR NOT (hs OR ht)), {name} AS MATERIALIZED (SELECT src_ord, 'S-' || src_ord AS src_id, tgt_ord, 'L-' || tgt_ord AS tgt_id, score FROM {name}_r WHERE done)"""


GREEDY = f"{EDGES}, {greedy_sql('m', 'edges')}"
STATUS = "CASE WHEN score >= 0.95 THEN 'AUTO' ELSE 'SUGGESTED' END"
CHAIN = f"""{GREEDY}, edges2 AS (SELECT s.ord AS src_ord, t.ord AS tgt_ord, CAST(1.0 AS DOUBLE) AS score, 0 AS r2, 0 AS r3 FROM src s JOIN tgt t ON s.reference = t.reference
    WHERE s.ord NOT IN (SELECT src_ord FROM m) AND t.ord NOT IN (SELECT tgt_ord FROM m)), {greedy_sql('n', 'edges2')},
    matches AS MATERIALIZED (SELECT src_ord, tgt_ord, src_id, tgt_id, score, {STATUS} AS status, 'amount and date' AS rule FROM m UNION ALL SELECT src_ord, tgt_ord, src_id, tgt_id, score, 'AUTO', 'reference' FROM n)"""
LEFT = "left_over AS (SELECT * FROM (SELECT *, 'SOURCE' AS side FROM src WHERE ord NOT IN (SELECT src_ord FROM matches) UNION ALL SELECT *, 'TARGET' FROM tgt WHERE ord NOT IN (SELECT tgt_ord FROM matches)))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = rules.parse(rules.AMOUNT_DATE)
    return matching.scored(matching.candidates(*ledgers(spark, sf_dir), rule.keys), rule)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_chain(*ledgers(spark, sf_dir), [rules.parse(rules.REFERENCE_ONLY), rules.parse(rules.AMOUNT_DATE)])


def _met(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("s.ord").alias("src_ord"), F.col("t.ord").alias("tgt_ord"))


# ---------------------------------------------------------------- candidates
@query("SELECT s.ord AS src_ord, t.ord AS tgt_ord FROM src s JOIN tgt t ON s.reference = t.reference", ledgers=True)
def block_exact(spark, sf_dir):
    return _met(matching.candidates(*ledgers(spark, sf_dir), (rules.Key("reference"),)))


@query("SELECT s.ord AS src_ord, t.ord AS tgt_ord FROM src s JOIN tgt t ON s.account_id = replace(t.account_id, 'GL', 'BANK') AND s.currency = t.currency AND abs(date_diff('day', s.value_date, t.value_date)) <= 2", ledgers=True)
def block_date(spark, sf_dir):
    s, t = ledgers(spark, sf_dir)
    return _met(matching.candidates(s, t.withColumn("account_id", F.regexp_replace("account_id", "^GL", "BANK")), (rules.Key("account_id"), rules.Key("currency"), rules.Key("value_date", "date_window", days=1))))


@query(f"SELECT s.ord AS src_ord, t.ord AS tgt_ord FROM src s JOIN tgt t ON abs({BUCKET.format('s.base_amount')} - {BUCKET.format('t.base_amount')}) <= 2", ledgers=True)
def block_numeric(spark, sf_dir):
    return _met(matching.candidates(*ledgers(spark, sf_dir), (rules.Key("base_amount", "numeric", amount=Decimal("0.01")),)))


@query("SELECT s.ord AS src_ord, t.ord AS tgt_ord FROM src s JOIN tgt t ON abs(round(s.base_amount) - round(t.base_amount)) <= 2 AND s.reference = rtrim(t.reference, 'X')", ledgers=True)
def block_unit(spark, sf_dir):
    """A numeric key without a tolerance has bands of width one."""
    s, t = ledgers(spark, sf_dir)
    return _met(matching.candidates(s, t.withColumn("reference", F.rtrim("reference", F.lit("X"))), (rules.Key("base_amount", "numeric"), rules.Key("reference"))))


_SIGNED = "CASE WHEN ord % 50 = 0 THEN 0 WHEN ord % 3 = 0 THEN -base_amount ELSE base_amount END"


@query(f"SELECT s.ord AS src_ord, t.ord AS tgt_ord FROM (SELECT *, {_SIGNED} AS a FROM src) s JOIN (SELECT *, {_SIGNED.replace('% 3', '% 4')} AS a FROM tgt) t ON s.tenant_id = t.tenant_id AND s.value_date = t.value_date AND sign(s.a) = sign(t.a)", ledgers=True)
def block_percent(spark, sf_dir):
    """A percentage is measured by each record's own amount, so all amounts of one sign share a band."""
    s, t = ledgers(spark, sf_dir)
    signed = lambda x, n: x.withColumn("base_amount", F.expr(_SIGNED.replace("% 3", f"% {n}")).cast("decimal(20,4)"))
    keys = (rules.Key("tenant_id"), rules.Key("value_date", "date_window", days=0), rules.Key("base_amount", "numeric", percent=Decimal("0.05")))
    return _met(matching.candidates(signed(s, 3), signed(t, 4), keys))


@query(f"SELECT s.ord AS src_ord, t.ord AS tgt_ord {EDGE_FROM}", ledgers=True)
def block_composite(spark, sf_dir):
    return _met(matching.candidates(*ledgers(spark, sf_dir), rules.parse(rules.AMOUNT_DATE).keys))


# ---------------------------------------------------------------- scores
@query(f"SELECT s.ord, CASE WHEN s.reference = t.reference THEN 1.0 ELSE 0.0 END::DOUBLE AS score {PAIRS}", ledgers=True)
def score_exact(spark, sf_dir):
    return similarity.scored_pairs(pairs(spark, sf_dir), "reference_s", "reference_t", "exact").select("ord", "score")


_PREFIX = "CASE WHEN a = '' OR b = '' OR a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 WHEN a[4] <> b[4] THEN 3 ELSE 4 END"
#: Texts whose matching characters are out of order in many ways, and empty ones.
_MIXED = "CASE ord % 4 WHEN 0 THEN s.reference WHEN 1 THEN substr(sha256(s.reference), 1, 8) WHEN 2 THEN '' ELSE substr(s.reference, 4) || substr(s.reference, 1, 3) END"
_OTHER = "CASE ord % 5 WHEN 0 THEN reverse(t.reference) || 'REF' WHEN 1 THEN substr(sha256(t.reference), 3, 8) WHEN 2 THEN '' ELSE t.reference END"


@query(f"WITH p AS (SELECT ord, {_MIXED} AS a, {_OTHER} AS b FROM src s JOIN tgt t USING (ord)), q AS (SELECT *, CASE WHEN a = '' AND b = '' THEN 1.0 ELSE jaro_similarity(a, b) END AS j FROM p) SELECT ord, round(j + 0.1 * ({_PREFIX}) * (1 - j), 9) AS score FROM q", ledgers=True)
def score_jaro_winkler(spark, sf_dir):
    spell = lambda sql: F.expr(sql.replace("sha256(s.reference)", "sha2(s.reference, 256)").replace("sha256(t.reference)", "sha2(t.reference, 256)").replace("s.reference", "reference_s").replace("t.reference", "reference_t"))
    p = pairs(spark, sf_dir).select("ord", spell(_MIXED).alias("a"), spell(_OTHER).alias("b"))
    distinct = p.select("a", "b").distinct().withColumn("score", F.round(similarity.jaro_winkler_column(F.col("a"), F.col("b")), 9))
    return p.join(distinct, ["a", "b"]).select("ord", "score")


@query(f"SELECT s.ord, round({LEVENSHTEIN.format('s.reference', 't.reference')}, 9) AS score {PAIRS}", ledgers=True)
def score_levenshtein(spark, sf_dir):
    return similarity.scored_pairs(pairs(spark, sf_dir), "reference_s", "reference_t", "levenshtein_normalized").select("ord", F.round("score", 9).alias("score"))


@query(f"SELECT s.ord, round(CAST({NUMERIC.format('s.base_amount', 't.base_amount')} AS DOUBLE), 9) AS score, round(CASE WHEN g <= w THEN 1 WHEN g >= 2 * w THEN 0 ELSE 1 - (g - w) / w END, 6) AS share FROM (SELECT *, abs(base_amount) * 0.00000005 AS tol FROM src) s JOIN tgt t ON s.ord = t.ord, LATERAL (SELECT CAST(abs(s.base_amount - t.base_amount) AS DOUBLE) AS g, CAST(greatest(0.001, CAST(s.tol AS DECIMAL(38,10))) AS DOUBLE) AS w)", ledgers=True)
def score_numeric(spark, sf_dir):
    """The rule's own tolerance of a cent, and a share of the amount where it is larger than a tenth of a cent."""
    p = pairs(spark, sf_dir)
    share = similarity.numeric(F.col("base_amount_s"), F.col("base_amount_t"), "0.001", "0.00000005")
    return similarity.scored_pairs(p, "base_amount_s", "base_amount_t", "numeric_closeness").select("ord", F.round("score", 9).alias("score"), F.round(share, 6).alias("share"))


@query(f"SELECT s.ord, round({DATE.format('s.value_date', 't.value_date')}, 9) AS score {PAIRS}", ledgers=True)
def score_date(spark, sf_dir):
    return similarity.scored_pairs(pairs(spark, sf_dir), "value_date_s", "value_date_t", "date_proximity").select("ord", F.round("score", 9).alias("score"))


@query(f"SELECT s.ord AS src_ord, t.ord AS tgt_ord, {TOTAL} AS score, round({PARTS[0]}, 9) AS reference, round({PARTS[1]}, 9) AS base_amount, round({PARTS[2]}, 9) AS value_date {EDGE_FROM} AND {TOTAL} >= 0.6", ledgers=True)
def score_composite(spark, sf_dir):
    """The weighted score, and why: the scores by field."""
    rule = rules.parse(rules.AMOUNT_DATE)
    out = matching.scored(matching.candidates(*ledgers(spark, sf_dir), rule.keys), rule, breakdown=True)
    return out.select("src_ord", "tgt_ord", "score", *[F.round(F.col("field_scores").getItem(f), 9).alias(f) for f in ("reference", "base_amount", "value_date")])


@query(f"WITH {EDGES} SELECT src_ord, tgt_ord, score FROM (SELECT *, row_number() OVER (PARTITION BY src_ord ORDER BY score DESC, r2, r3, tgt_ord) AS place FROM edges) WHERE place = 1", ledgers=True)
def best_candidate(spark, sf_dir):
    return matching.best_candidate(edges(spark, sf_dir)).select("src_ord", "tgt_ord", "score")


@query(f"WITH {EDGES} SELECT {STATUS} AS status, count(*) AS n FROM edges GROUP BY 1", ledgers=True)
def classify(spark, sf_dir):
    return edges(spark, sf_dir).groupBy(matching.classify(F.col("score"), rules.parse(rules.AMOUNT_DATE)).alias("status")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- matches
@query(f"WITH RECURSIVE {GREEDY} SELECT src_ord, tgt_ord, src_id, tgt_id, score, {STATUS} AS status, 'amount and date' AS rule FROM m", ledgers=True)
def match_greedy(spark, sf_dir):
    return matching.match(*ledgers(spark, sf_dir), rules.parse(rules.AMOUNT_DATE))


@query(f"WITH RECURSIVE {CHAIN} SELECT * FROM matches", ledgers=True)
def match_priority_chain(spark, sf_dir):
    return chain(spark, sf_dir)


@query(f"WITH RECURSIVE {CHAIN}, {LEFT} SELECT id, account_id, base_amount, side FROM left_over", ledgers=True, money=("base_amount",))
def match_unmatched(spark, sf_dir):
    return matching.unmatched(*ledgers(spark, sf_dir), chain(spark, sf_dir)).select("id", "account_id", "base_amount", "side")


@query(f"WITH RECURSIVE {CHAIN}, {LEFT} SELECT 'BREAK-' || id AS id, id AS transaction_id, 'UNMATCHED' AS break_type, 'OPEN' AS status, base_amount AS amount_at_risk FROM left_over", ledgers=True, money=("amount_at_risk",))
def open_breaks(spark, sf_dir):
    return matching.breaks(matching.unmatched(*ledgers(spark, sf_dir), chain(spark, sf_dir)))


@query(f"WITH RECURSIVE {CHAIN} SELECT s.id, CASE WHEN m.status = 'AUTO' THEN 'MATCHED' ELSE 'UNMATCHED' END AS status FROM src s LEFT JOIN matches m ON s.ord = m.src_ord", ledgers=True)
def apply_match_status(spark, sf_dir):
    return matching.with_status(C.source_ledger(spark, sf_dir), chain(spark, sf_dir), "src").select("id", "status")


_LINES = "SELECT src_id || '>' || tgt_id AS result_id, src_id AS transaction_id, 'SOURCE' AS side, s.base_amount AS allocated_amount FROM matches JOIN src s ON s.ord = src_ord UNION ALL SELECT src_id || '>' || tgt_id, tgt_id, 'TARGET', t.base_amount FROM matches JOIN tgt t ON t.ord = tgt_ord"


@query(f"WITH RECURSIVE {CHAIN} {_LINES}", ledgers=True, money=("allocated_amount",))
def match_result_lines(spark, sf_dir):
    s, t = ledgers(spark, sf_dir)
    return matching.results(chain(spark, sf_dir), s, t)[1]


@query(f"WITH RECURSIVE {CHAIN}, l AS ({_LINES}) SELECT result_id, transaction_id, side, 0.0::DOUBLE AS allocated_amount FROM l WHERE result_id IN (SELECT src_id || '>' || tgt_id FROM matches WHERE status = 'AUTO')", ledgers=True)
def provisional_lines(spark, sf_dir):
    """The lines of a stream's results, which allocate nothing yet."""
    s, t = ledgers(spark, sf_dir)
    return matching.results(chain(spark, sf_dir), s, t, provisional=True)[1]


@query(f"WITH RECURSIVE {CHAIN}, {LEFT} SELECT rule, status, count(*) AS n FROM matches GROUP BY ALL UNION ALL SELECT '', 'UNMATCHED', count(*) FROM left_over", ledgers=True)
def outcome_counts(spark, sf_dir):
    found = chain(spark, sf_dir)
    return matching.outcome_counts(found, matching.unmatched(*ledgers(spark, sf_dir), found))


# ---------------------------------------------------------------- groups
_AMOUNT = "CAST(round(l_extendedprice * (1 - l_discount), 2) AS DECIMAL(20,4))"
#: Wanted sums: those of the lines whose places have a pattern by the order's number, some a little off, some of nothing.
_WANT = "sum(CASE WHEN (k + i * i) % 3 = 0 THEN a ELSE 0 END) + CASE k % 7 WHEN 1 THEN 0.005 WHEN 2 THEN 12.34 WHEN 3 THEN -0.01 ELSE 0 END"


def _group_sql(most: int, near: str) -> str:
    return f"""WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, {_AMOUNT} AS a FROM lineitem),
    w AS (SELECT k, {_WANT} AS want FROM l GROUP BY k), c AS (SELECT k, 1 AS size, [i] AS places, i AS last, a AS total FROM l UNION ALL SELECT c.k, size + 1, list_append(places, l.i), l.i, total + a FROM c JOIN l ON l.k = c.k AND l.i > c.last WHERE size < {most}),
    f AS (SELECT w.k, size, places FROM c JOIN w ON w.k = c.k WHERE {near}), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, places) AS place FROM f)
    SELECT w.k AS order_key, array_to_string(b.places, ',') AS places FROM w LEFT JOIN b ON b.k = w.k AND b.place = 1"""


def _groups(spark: SparkSession, sf_dir: str, most: int, absolute: str = "0", percent: str = "0") -> DataFrame:
    order = Window.partitionBy("k").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k").select("k", F.row_number().over(order).cast("long").alias("i"), F.expr(_AMOUNT).alias("a"))
    want = lines.groupBy("k").agg(F.sum(F.expr("CASE WHEN (k + i * i) % 3 = 0 THEN a ELSE CAST(0 AS DECIMAL(20,4)) END")).alias("s"))
    want = want.select(F.col("k").alias("key"), (F.col("s") + F.expr("CAST(CASE k % 7 WHEN 1 THEN '0.005' WHEN 2 THEN '12.34' WHEN 3 THEN '-0.01' ELSE '0' END AS DECIMAL(20,4))")).alias("amount"))
    found = matching.find_groups(lines.select(F.col("k").alias("key"), F.col("i").alias("place"), F.col("a").alias("amount")), want, absolute, percent, most)
    return found.select(F.col("key").alias("order_key"), F.array_join("places", ",").alias("places"))


@query(_group_sql(2, "abs(total - want) <= 0.01"))
def find_group_2(spark, sf_dir):
    """The first one or two lines of each order whose sum is the wanted one to a cent."""
    return _groups(spark, sf_dir, 2, absolute="0.01")


@query(_group_sql(3, "abs(total - want) <= abs(want) * 0.001"))
def find_group_3(spark, sf_dir):
    """Up to three lines, to a thousandth of the wanted sum."""
    return _groups(spark, sf_dir, 3, percent="0.001")


@query(_group_sql(5, "total = want"))
def find_group_5(spark, sf_dir):
    """Up to five lines, exactly."""
    return _groups(spark, sf_dir, 5)


# ---------------------------------------------------------------- review and reconciliation
_SUGGESTED = "results AS (SELECT src_id || '>' || tgt_id AS result_id, src_id, tgt_id, CASE WHEN score >= 0.95 THEN 'AUTO' ELSE 'SUGGESTED' END AS status, score, src_ord FROM m)"
_REVIEWED = f"""{_SUGGESTED}, {C.DECISIONS_SQL}, reviewed AS (SELECT d.result_id, d.decision, d.actor, coalesce(r.status = 'SUGGESTED' AND d.decision IN ('CONFIRM', 'REJECT') AND d.actor <> '', false) AS succeeded, r.status AS was, r.src_id, r.tgt_id, r.src_ord
    FROM decisions d LEFT JOIN results r USING (result_id))"""


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, t = ledgers(spark, sf_dir)
    return matching.results(matching.match(s, t, rules.parse(rules.AMOUNT_DATE)), s, t)


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    results, lines = _results(spark, sf_dir)
    return reconciling.review(results, C.decisions(C.source_ledger(spark, sf_dir))), lines


@query(f"WITH RECURSIVE {GREEDY}, {_SUGGESTED} SELECT result_id, status, score, src_id AS source_ids, tgt_id AS target_ids FROM results WHERE status = 'SUGGESTED'", ledgers=True)
def suggested_matches(spark, sf_dir):
    """Suggested results with their lines gathered by side."""
    results, lines = _results(spark, sf_dir)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return reconciling.nested(results.where("status = 'SUGGESTED'"), lines).select("result_id", "status", "score", joined("source_ids"), joined("target_ids"))


@query(f"WITH RECURSIVE {GREEDY}, {_REVIEWED} SELECT result_id, decision, actor, succeeded, CASE WHEN succeeded THEN CASE decision WHEN 'CONFIRM' THEN 'CONFIRMED' ELSE 'REJECTED' END ELSE was END AS status FROM reviewed", ledgers=True)
def review_apply(spark, sf_dir):
    """Each reviewer's decision with its success and the result's status after it."""
    return _reviewed(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {GREEDY}, {_REVIEWED}, x AS (SELECT unnest([src_id, tgt_id]) AS transaction_id, CASE decision WHEN 'CONFIRM' THEN 'MATCHED' ELSE 'UNMATCHED' END AS status FROM reviewed WHERE succeeded) SELECT * FROM x", ledgers=True)
def review_transactions(spark, sf_dir):
    """The transactions that decisions have moved."""
    return reconciling.reviewed_transactions(*_reviewed(spark, sf_dir))


@query(f"WITH RECURSIVE {GREEDY}, {_REVIEWED} SELECT result_id, 'UNMATCHED' AS break_type, src_id || ',' || tgt_id AS transaction_ids, CAST(s.base_amount AS DOUBLE) AS amount_at_risk FROM reviewed JOIN src s ON s.ord = src_ord WHERE succeeded AND decision = 'REJECT'", ledgers=True)
def review_breaks(spark, sf_dir):
    """One break over all transactions of each rejected result."""
    return reconciling.rejected_breaks(*_reviewed(spark, sf_dir)).withColumn("transaction_ids", F.array_join("transaction_ids", ","))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, t = ledgers(spark, sf_dir)
    batch = matching.match(s, t, rules.parse(rules.AMOUNT_DATE)).where("status = 'AUTO'")
    return batch.select(F.col("src_ord").alias("ord"), F.array("src_id", "tgt_id").alias("ids")), C.stream_results(t)


_SHARED = f"""{C.STREAM_SQL}, batch AS (SELECT src_ord AS ord, [src_id, tgt_id] AS ids FROM m WHERE score >= 0.95), bx AS (SELECT ord, unnest(ids) AS id FROM batch), sx AS (SELECT ord, unnest(ids) AS id FROM stream),
    shared AS MATERIALIZED (SELECT bx.ord AS batch_ord, sx.ord AS stream_ord, count(*) AS shared FROM bx JOIN sx USING (id) GROUP BY ALL)"""
_RECONCILED = f"""{_SHARED}, edges3 AS (SELECT batch_ord AS src_ord, stream_ord AS tgt_ord, 1.0::DOUBLE AS score, 0 AS r2, 0 AS r3 FROM shared), {greedy_sql('p', 'edges3')},
    outcomes AS (SELECT s.ord AS stream_ord, p.src_ord AS batch_ord, list_sort(s.ids) AS stream_ids, list_sort(b.ids) AS batch_ids, coalesce(list_sort(s.ids) = list_sort(b.ids), false) AS same FROM stream s LEFT JOIN p ON p.tgt_ord = s.ord LEFT JOIN batch b ON b.ord = p.src_ord)"""


@query(f"WITH RECURSIVE {GREEDY}, {_RECONCILED} SELECT stream_ord, coalesce(batch_ord, -1) AS batch_ord, CASE WHEN same THEN 'AUTO_MATCHED_CONFIRMED' ELSE 'RECONCILIATION_VARIANCE' END AS outcome, CASE WHEN batch_ord IS NULL THEN 'no_confirming_match_found' WHEN NOT same THEN 'different_transactions' END AS reason FROM outcomes", ledgers=True)
def reconcile(spark, sf_dir):
    """A stream's results against the batch's: confirmed, varying, or without a partner."""
    return reconciling.reconcile(*_both(spark, sf_dir)).drop("stream_ids", "batch_ids").fillna(-1, ["batch_ord"])


@query(f"WITH RECURSIVE {GREEDY}, {_SHARED} SELECT * FROM shared", ledgers=True)
def reconcile_overlap(spark, sf_dir):
    return reconciling.overlaps(*_both(spark, sf_dir))


@query(f"""WITH RECURSIVE {GREEDY}, {_RECONCILED} SELECT stream_ord AS result, 'RECONCILIATION_VARIANCE' AS break_type, array_to_string(stream_ids, ',') AS transaction_ids, CASE WHEN batch_ord IS NULL
    THEN '{{"streaming_transaction_ids":["' || array_to_string(stream_ids, '","') || '"],"batch_outcome":"no_confirming_match_found"}}'
    ELSE '{{"streaming_transaction_ids":["' || array_to_string(stream_ids, '","') || '"],"batch_transaction_ids":["' || array_to_string(batch_ids, '","') || '"],"batch_outcome":"different_transactions"}}' END AS payload FROM outcomes WHERE NOT same""", ledgers=True)
def variance_payload(spark, sf_dir):
    """The breaks of variances, with what either side said."""
    return reconciling.variances(reconciling.reconcile(*_both(spark, sf_dir))).withColumn("transaction_ids", F.array_join("transaction_ids", ","))


@query(f"""WITH RECURSIVE {GREEDY}, {_RECONCILED} SELECT stream_ord AS aggregate_id, 'match.auto_confirmed' AS event_type, 'case.events.default' AS topic, '{{"match_result_id":' || stream_ord || ',"confirmed_at":"2024-01-01"}}' AS payload FROM outcomes WHERE same""", ledgers=True)
def confirmed_events(spark, sf_dir):
    return reconciling.confirmations(reconciling.reconcile(*_both(spark, sf_dir)), F.lit("2024-01-01"))


# ---------------------------------------------------------------- partitions and rules
_DAYS = "SELECT a.tenant_id, a.value_date, a.account_id AS source_account, b.account_id AS target_account FROM u a JOIN u b ON a.tenant_id = b.tenant_id AND a.value_date = b.value_date AND a.account_id < b.account_id"
_STATE = "(SELECT *, CASE WHEN ord % 8 = 0 THEN 'MATCHED' ELSE 'UNMATCHED' END AS status, CAST(value_date AS TIMESTAMP) + to_days(CAST(ord % 30 AS INTEGER)) AS updated_at FROM (SELECT * FROM src UNION ALL SELECT * FROM tgt))"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = ledgers(spark, sf_dir)
    both = s.unionByName(t).withColumn("status", F.when(F.col("ord") % 8 == 0, "MATCHED").otherwise("UNMATCHED"))
    return both.withColumn("updated_at", F.date_add("value_date", (F.col("ord") % 30).cast("int")).cast("timestamp"))


@query(f"WITH u AS (SELECT DISTINCT tenant_id, value_date, account_id FROM {_STATE} WHERE status = 'UNMATCHED') {_DAYS}", ledgers=True)
def enumerate_partitions(spark, sf_dir):
    return scans.partitions(_state(spark, sf_dir))


@query(f"WITH u AS (SELECT DISTINCT tenant_id, value_date, account_id FROM {_STATE} WHERE status = 'UNMATCHED' AND updated_at >= TIMESTAMP '1999-01-01') {_DAYS}", ledgers=True)
def enumerate_since(spark, sf_dir):
    return scans.partitions(_state(spark, sf_dir), since="1999-01-01")


@query("SELECT account_id, CAST(day AS DATE) AS partition_day, count(*) AS n FROM (SELECT account_id, unnest(generate_series(value_date - 4, value_date + 3, INTERVAL 1 DAY)) AS day FROM src) GROUP BY ALL", ledgers=True)
def partition_load(spark, sf_dir):
    """The rows that each day's partition loads: from three days before to four days after it."""
    days = C.source_ledger(spark, sf_dir).select("account_id", F.explode(F.sequence(F.date_add("value_date", -4), F.date_add("value_date", 3))).alias("partition_day"))
    return days.groupBy("account_id", "partition_day").agg(F.count("*").alias("n"))


@query("SELECT tenant_id, account_id, count(*) AS n, count(*) > 50000 AS too_large FROM src GROUP BY ALL", ledgers=True)
def partition_sizes(spark, sf_dir):
    return C.source_ledger(spark, sf_dir).groupBy("tenant_id", "account_id").agg(F.count("*").alias("n")).withColumn("too_large", F.col("n") > 50_000)


@query("SELECT CASE WHEN n <= 1 THEN 1 WHEN n <= 3 THEN 3 WHEN n <= 5 THEN 5 ELSE -1 END::BIGINT AS up_to, count(*) AS n FROM (SELECT count(*) AS n FROM src GROUP BY tenant_id, account_id, value_date) GROUP BY 1", ledgers=True)
def partition_histogram(spark, sf_dir):
    return scans.size_histogram(C.source_ledger(spark, sf_dir), (1, 3, 5))


#: Rules of the nations' accounts: several of one name on a pair, drafts, and some with an odd status.
_RULES = """rules AS (SELECT 'R-' || x AS id, 'T-' || (x % 2) AS tenant_id, 'BANK-' || (x % 5) AS source_account, 'GL-' || (x % 4) AS target_account, 'rule ' || (x % 3) AS name, CAST(x % 7 AS BIGINT) AS priority, CAST(x AS BIGINT) AS version,
    CASE x % 4 WHEN 0 THEN 'ACTIVE' WHEN 3 THEN 'ARCHIVED' ELSE 'DRAFT' END AS status, 'U-' || (x % 6) AS created_by FROM range(400) r(x))"""


def _rules(spark: SparkSession) -> DataFrame:
    x = F.col("id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c)
    return spark.range(400).select(
        text("R-", x).alias("id"), text("T-", x % 2).alias("tenant_id"), text("BANK-", x % 5).alias("source_account"), text("GL-", x % 4).alias("target_account"), text("rule ", x % 3).alias("name"), (x % 7).alias("priority"), x.alias("version"),
        F.when(x % 4 == 0, "ACTIVE").when(x % 4 == 3, "ARCHIVED").otherwise("DRAFT").alias("status"), text("U-", x % 6).alias("created_by"),
    )


@query(f"WITH {_RULES} SELECT id, priority, version FROM rules WHERE status = 'ACTIVE' AND source_account = 'BANK-0' AND target_account = 'GL-0' UNION ALL SELECT id, priority, version FROM rules WHERE status = 'ACTIVE' AND source_account = 'GL-0' AND target_account = 'BANK-0'")
def rules_for_pair(spark, sf_dir):
    """The active rules of one pair of accounts, written in either direction."""
    return reconciling.rules_for_pair(_rules(spark), "BANK-0", "GL-0").select("id", "priority", "version")


_REQUESTS = "requests AS (SELECT 'R-' || (x * 3) AS rule_id, CASE WHEN x % 10 = 9 THEN '' ELSE 'U-' || (x % 5) END AS approver FROM range(150) q(x))"
_ASKED = f"""{_RULES}, {_REQUESTS}, asked AS (SELECT q.*, r.*, CASE WHEN approver = '' THEN 'approved_by must be set' WHEN r.id IS NULL THEN 'no such rule' WHEN approver = created_by THEN 'the maker may not approve' WHEN status <> 'DRAFT' THEN 'no move from ' || status END AS reason FROM requests q LEFT JOIN rules r ON r.id = rule_id)"""


def _activated(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    x = F.col("id")
    requests = spark.range(150).select(F.concat(F.lit("R-"), x * 3).alias("rule_id"), F.when(x % 10 == 9, "").otherwise(F.concat(F.lit("U-"), x % 5)).alias("approver"))
    return reconciling.activate(_rules(spark), requests)


@query(f"""WITH {_ASKED}, good AS (SELECT * FROM asked WHERE reason IS NULL), newest AS (SELECT tenant_id, source_account, target_account, name, max(version) AS v FROM good GROUP BY ALL)
    SELECT r.id, CASE WHEN r.id IN (SELECT id FROM good) AND r.version = n.v THEN 'ACTIVE' WHEN n.v IS NOT NULL AND (r.status = 'ACTIVE' OR r.id IN (SELECT id FROM good)) THEN 'ARCHIVED' ELSE r.status END AS status FROM rules r LEFT JOIN newest n USING (tenant_id, source_account, target_account, name)""")
def rule_activate(spark, sf_dir):
    """Rules after requests for activation: an activated rule archives those of its name on its pair."""
    return _activated(spark)[0].select("id", "status")


@query(f"WITH {_ASKED} SELECT rule_id, approver, reason IS NULL AS succeeded, reason FROM asked")
def rule_requests(spark, sf_dir):
    """What became of each request."""
    return _activated(spark)[1]


# ---------------------------------------------------------------- scans
@query("SELECT id, account_id, base_amount, value_date FROM src WHERE tenant_id = 'T-1' AND value_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND currency = 'EUR'", ledgers=True, money=("base_amount",))
def list_transactions(spark, sf_dir):
    return scans.transactions(C.source_ledger(spark, sf_dir), "T-1", currency="EUR", since="1997-01-01", until="1999-12-31").select("id", "account_id", "base_amount", "value_date")


@query("SELECT id, base_amount FROM src WHERE tenant_id = 'T-2'", ledgers=True, money=("base_amount",))
def tenant_scope(spark, sf_dir):
    return scans.of_tenant(C.source_ledger(spark, sf_dir), "T-2").select("id", "base_amount")


@query("SELECT id, base_amount FROM src ORDER BY base_amount DESC, id LIMIT 100", ledgers=True, money=("base_amount",))
def topk_unmatched(spark, sf_dir):
    return C.source_ledger(spark, sf_dir).orderBy(F.col("base_amount").desc(), "id").limit(100).select("id", "base_amount")


@query("SELECT id, priority, amount_at_risk FROM cases WHERE tenant_id = 'T-3' AND status = 'OPEN' AND assignee = 'U-3' AND account_id = 'ACC-5' AND priority = 'HIGH'", cases=True, money=("amount_at_risk",))
def list_breaks(spark, sf_dir):
    return scans.breaks(C.cases(spark, sf_dir), "T-3", status="OPEN", assignee="U-3", account="ACC-5", priority="HIGH").select("id", "priority", "amount_at_risk")


@query("SELECT id FROM cases WHERE status NOT IN ('RESOLVED','WRITTEN_OFF') AND workflow_id IS NULL", cases=True)
def backfill_candidates(spark, sf_dir):
    return scans.backfill_candidates(C.cases(spark, sf_dir)).select("id")
