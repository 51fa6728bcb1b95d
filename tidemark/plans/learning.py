"""Registered queries on what is learnt from: selected policies, lineage, funnels, features out of JSON, recorded messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import eligibility as EL
from ..functions import features as X
from ..functions import policy as P
from ..operators import calibrator, crossfit, lineage, selection
from ..sources.recorded import RecordedMessages
from ..sources.shared import shared_dir
from ..sources.tables import epoch, table
from ..streaming import states
from .market import DAY, _drained, query, r

GRID = [0.2, 0.4, 0.5, 0.55, 0.7, 0.9]


@query(f"""WITH RECURSIVE x AS (SELECT l_suppkey % 7 AS k, l_partkey % 100 / 100.0::DOUBLE AS c, l_discount - l_tax + l_orderkey / 1e9 AS r, l_quantity AS w, epoch_us(l_shipdate) // 1000000 AS ts, epoch_us(l_shipdate) // 1000000 + 864000 * (1 + l_linenumber) AS e FROM lineitem),
t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in GRID)}]) AS th), s AS (SELECT * FROM x, t WHERE c + 1e-12 >= th),
b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY k, th ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, 0.2::DOUBLE * sum(w) OVER (PARTITION BY k, th) AS fifth FROM s),
m AS (SELECT k, th, count(*) AS samples, sum(w * r) / sum(w) AS mean, sum(w) * sum(w) / sum(w * w) AS n_eff, sum(least(w, greatest(0, fifth - before)) * r) / max(fifth) AS shortfall FROM b GROUP BY k, th),
d AS (SELECT k, th, ts, max(e) AS e, sum(w * r) / sum(w) AS r, max(w) AS w FROM s GROUP BY k, th, ts),
g AS (SELECT k, th, min({{'e': e, 'ts': ts}}) AS at FROM d GROUP BY k, th UNION ALL SELECT g.k, g.th, (SELECT min({{'e': d.e, 'ts': d.ts}}) FROM d WHERE d.k = g.k AND d.th = g.th AND d.ts >= g.at.e) FROM g WHERE EXISTS (SELECT 1 FROM d WHERE d.k = g.k AND d.th = g.th AND d.ts >= g.at.e)),
q AS (SELECT d.k, d.th, count(*) AS clusters, sum(w * r) / sum(w) AS temporal_mean, sum(w) * sum(w) / sum(w * w) AS temporal_n_eff FROM d JOIN g ON g.k = d.k AND g.th = d.th AND g.at.ts = d.ts GROUP BY d.k, d.th)
SELECT m.k, m.th AS threshold, samples, round(mean, 7) AS mean, round(n_eff, 3) AS n_eff, round(shortfall, 7) AS shortfall, clusters, round(temporal_mean, 7) AS temporal_mean, round(temporal_n_eff, 4) AS temporal_n_eff FROM m JOIN q USING (k, th)""")
def selected_policy(spark, d):
    """Returns of line items at or above each threshold of confidence."""
    ts = epoch(F.col("l_shipdate"))
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("k"), (F.col("l_partkey") % 100 / 100.0).alias("c"), (F.col("l_discount") - F.col("l_tax") + F.col("l_orderkey") / 1e9).alias("ret"), F.col("l_quantity").alias("w"), ts.alias("ts"), (ts + 10 * DAY * (1 + F.col("l_linenumber"))).alias("available"))
    got = selection.selected_returns(x, "k", GRID, "c", "ret", "w", "ts", "available", least=20)
    return got.where("samples > 0").select("k", "threshold", "samples", r("mean", 7).alias("mean"), r("n_eff", 3).alias("n_eff"), r("shortfall", 7).alias("shortfall"), "clusters", r("temporal_mean", 7).alias("temporal_mean"), r("temporal_n_eff", 4).alias("temporal_n_eff"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000000 AS ts, o_orderkey % 9 <> 0 AS reuse, lag(o_orderkey) OVER w AS old, lead(o_orderkey) OVER w AS new FROM orders WINDOW w AS (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey)),
x AS (SELECT id, ts, CASE WHEN NOT reuse THEN NULL WHEN id % 97 = 1 THEN -id WHEN id % 41 = 2 THEN new ELSE old END AS p FROM o),
l AS (SELECT x.*, q.ts AS pts, coalesce(q.ts < x.ts OR q.ts = x.ts AND q.id < x.id, false) AS linked FROM x LEFT JOIN x AS q ON q.id = x.p),
g AS (SELECT id, coalesce(p, id) AS root, coalesce(pts, CASE WHEN p IS NULL THEN ts END) AS first, p IS NULL AS is_root FROM l WHERE NOT linked UNION ALL SELECT l.id, g.root, g.first, false FROM l JOIN g ON l.p = g.id WHERE l.linked)
SELECT id, root, is_root, first AS chain_first_ts FROM g""")
def publication_roots(spark, d):
    """Roots of orders as publications that reuse the one before of their group; some reuse what is unknown or comes later."""
    w = Window.partitionBy(F.col("o_custkey") % 20).orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), epoch(F.col("o_orderdate")).alias("ts"), (k % 9 != 0).alias("reuse"), F.when(k % 97 == 1, -k).when(k % 41 == 2, F.lead("o_orderkey").over(w)).otherwise(F.lag("o_orderkey").over(w)).alias("previous"))
    return lineage.roots(o, "id", "ts", "previous", "reuse")


@query("""WITH x AS (SELECT l_shipmode AS k, l_discount > 0.05 AS win, [l_linestatus = 'O', l_discount IS NOT NULL AND l_quantity > 5, l_tax <= 0.06, l_linenumber < 6, l_partkey % 10 <> 3, l_suppkey % 8 <> 1] AS t FROM (SELECT *, ['a', 'b', 'c'][1 + l_partkey % 3] AS l_shipmode FROM lineitem)),
f AS (SELECT *, CASE WHEN NOT t[1] THEN 1 WHEN NOT t[2] THEN 2 WHEN NOT t[3] THEN 3 WHEN NOT t[4] THEN 4 WHEN NOT t[5] THEN 5 WHEN NOT t[6] THEN 6 ELSE 7 END AS failed FROM x)
SELECT k, count(*) AS n, count(*) FILTER (win) AS wins, count(*) FILTER (failed > 1) AS current_model_n, count(*) FILTER (failed > 2) AS feature_eligible_n, count(*) FILTER (failed > 6) AS policy_eligible_n,
  count(*) FILTER (failed > 1 AND win) AS current_model_wins, count(*) FILTER (failed > 2 AND win) AS feature_eligible_wins, count(*) FILTER (failed > 6 AND win) AS policy_eligible_wins,
  count(*) FILTER (failed = 1) AS dropped_old_model, count(*) FILTER (failed = 2) AS dropped_invalid_feature_evidence, count(*) FILTER (failed = 3 OR failed = 5) AS dropped_candidate_policy, count(*) FILTER (failed = 4) AS dropped_invalid_policy_contract, count(*) FILTER (failed = 6) AS dropped_not_matured FROM f GROUP BY k""")
def lineage_funnel(spark, d):
    """How many line items are left after each condition, and what dropped the others."""
    x = table(spark, d, "lineitem").withColumn("k", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("l_partkey") % 3 + 1).cast("int")))
    tests = [
        ("current_model", "old_model", F.col("l_linestatus") == "O"), ("feature_eligible", "invalid_feature_evidence", F.col("l_discount").isNotNull() & (F.col("l_quantity") > 5)),
        ("policy_eligible", "candidate_policy", F.col("l_tax") <= 0.06), ("policy_eligible", "invalid_policy_contract", F.col("l_linenumber") < 6), ("policy_eligible", "candidate_policy", F.col("l_partkey") % 10 != 3), ("policy_eligible", "not_matured", F.col("l_suppkey") % 8 != 1),
    ]
    return lineage.funnel(x, "k", tests, F.col("l_discount") > 0.05)


_NAMES = [*[name for name, *_ in X.SNAPSHOT], "direction_sign", "sentiment_alignment"]
_NUMBER = lambda path: f"CASE WHEN json_type(j, '$.{path}') <> 'BOOLEAN' THEN try_cast(json_extract_string(j, '$.{path}') AS DOUBLE) END"
_SNAP = ", ".join(f"greatest({low}, least({high}, coalesce({_NUMBER('feature_snapshot.' + name)}, {'score' if default is None else default})))::DOUBLE AS s_{name}" for name, default, low, high in X.SNAPSHOT)
_SIDE = "CASE direction WHEN 'long' THEN 1.0 WHEN 'short' THEN -1.0 ELSE 0.0 END::DOUBLE"
_REBUILT = {
    "range_score": f"1 - least(1, abs(coalesce({_NUMBER('direction_agg.strength.all')}, 0)))", "trend_strength": f"least(1, abs(coalesce({_NUMBER('direction_agg.strength.all')}, 0)))", "atr_pct_norm": "least(2, coalesce(try_cast(json_extract_string(j, '$.top_negative_factors[1].value') AS DOUBLE), 0) / 0.10::DOUBLE)",
    "effective_sentiment": f"greatest(-1, least(1, coalesce({_NUMBER('effective_sentiment')}, 0)))", "dir_conf": f"coalesce({_NUMBER('direction_agg.direction_confidence')}, 0.5)", "coherence": "0.5", "spread_bps_norm": f"least(5, coalesce({_NUMBER('cost_model.total_cost_bps')}, 8) / 10.0)", "score": "greatest(-1, least(1, score))",
    "oi_4h_norm": f"greatest(-3, least(3, coalesce({_NUMBER('open_interest.oi_4h_chg_pct')}, 0) / 10))", "funding_norm": f"greatest(-2, least(2, coalesce({_NUMBER('funding.carry_cost_bps_8h')}, 0) / 20))", "liq_tier_num": "CASE json_extract_string(j, '$.liquidity.tier') WHEN 'low' THEN 0.33 WHEN 'high' THEN 1.0 ELSE 0.67 END", "btc_corr": "0.0", "regime_conf": "0.5",
}
REASONS = [
    "'{\"feature_snapshot\": {\"range_score\": 0.' || d1", "'{\"feature_snapshot\": {\"range_score\": 0.' || d1 || ', \"trend_strength\": \"0.' || d2 || '\", \"coherence\": true, \"effective_sentiment\": -0.' || d2 || ', \"oi_4h_norm\": ' || d1 || ', \"direction_sign\": 1}}'",
    "'{\"direction_agg\": {\"strength\": {\"all\": -0.' || d1 || '}, \"direction_confidence\": 0.' || d2 || '}, \"effective_sentiment\": 0.' || d1 || ', \"cost_model\": {\"total_cost_bps\": ' || d2 || '}, \"open_interest\": {\"oi_4h_chg_pct\": -' || d1 || '5}, \"funding\": {\"carry_cost_bps_8h\": ' || d2 || '1}, \"liquidity\": {\"tier\": \"Low\"}, \"top_negative_factors\": [{\"feature\": \"x\", \"value\": 1}, {\"feature\": \"atr_pct\", \"value\": 0.0' || d2 || '}]}'",
    "'[' || d1 || ']'", "NULL", "'{\"feature_snapshot\": {\"effective_sentiment\": 0.' || d1 || ', \"sentiment_alignment\": 0.' || d1 || ', \"score\": null, \"btc_corr\": -7}}'", "'{\"feature_snapshot\": {}, \"liquidity\": {\"tier\": \"high\"}}'",
]
_CASES = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(REASONS))


@query(f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 5 / 4.0 - 0.5 END::DOUBLE AS score, ['long', 'short', 'neutral'][1 + o_orderkey % 3] AS direction, (o_orderkey % 10)::VARCHAR AS d1, (o_custkey % 10)::VARCHAR AS d2 FROM orders),
y AS (SELECT *, CASE o_orderkey % 7 {_CASES} END AS raw FROM x), v AS (SELECT *, CASE WHEN json_valid(raw) AND raw[1] = '{{' THEN lower(raw)::JSON END AS j FROM y),
s AS (SELECT *, {_SIDE} AS side, coalesce(json_type(j, '$.feature_snapshot') = 'OBJECT' AND len(json_keys(j, '$.feature_snapshot')) > 0, false) AS has, {_SNAP} FROM v),
a AS (SELECT *, CASE WHEN side <> 0 THEN side * s_effective_sentiment ELSE -abs(s_effective_sentiment) END AS s_al, {', '.join(f'({x})::DOUBLE AS r_{name}' for name, x in _REBUILT.items())} FROM s),
c AS (SELECT *, CASE WHEN side <> 0 THEN side * r_effective_sentiment ELSE -abs(r_effective_sentiment) END AS r_al, CASE WHEN score IS NULL THEN 'NO_SCORE' WHEN j IS NULL THEN 'NO_REASONS' WHEN has AND json_exists(j, '$.feature_snapshot.direction_sign') AND coalesce(abs({_NUMBER('feature_snapshot.direction_sign')} - side) > 1e-12, true) THEN 'DIRECTION_SIGN_MISMATCH'
  WHEN has AND json_exists(j, '$.feature_snapshot.sentiment_alignment') AND coalesce(abs({_NUMBER('feature_snapshot.sentiment_alignment')} - s_al) > 1e-12, true) THEN 'SENTIMENT_ALIGNMENT_MISMATCH' END AS code FROM a)
SELECT o_orderkey, code, {', '.join(f'CASE WHEN code IS NULL THEN round(CASE WHEN has THEN s_{n} ELSE r_{n} END, 6) END AS {n}' for n, *_ in X.SNAPSHOT)}, CASE WHEN code IS NULL THEN side END AS direction_sign, CASE WHEN code IS NULL THEN round(CASE WHEN has THEN s_al ELSE r_al END, 6) END AS sentiment_alignment FROM c""")
def feature_vectors(spark, d):
    """Features out of JSON texts of several makes, malformed ones too."""
    k, d1, d2 = F.col("o_orderkey"), (F.col("o_orderkey") % 10).cast("string"), (F.col("o_custkey") % 10).cast("string")
    x = table(spark, d, "orders").select(k, d1.alias("d1"), d2.alias("d2"), F.when(k % 11 != 0, k % 5 / 4.0 - 0.5).alias("row_score"), F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("neutral")), (k % 3 + 1).cast("int")).alias("direction"))
    raw = F.expr(f"CASE o_orderkey % 7 {_CASES} END")
    x = x.withColumn("reasons", X.variant(raw))
    vector, code = X.features(F.col("reasons"), F.col("row_score"), F.col("direction"))
    x = x.withColumn("vector", vector).withColumn("code", code)
    return x.select("o_orderkey", "code", *[r(F.get("vector", i)).alias(name) for i, name in enumerate(_NAMES)])


@query("""WITH c AS (SELECT conv_id, turn, text, turn % 4 = 3 AS again FROM conversations)
SELECT conv_id, turn, true AS accepted FROM c UNION ALL SELECT conv_id, turn, false FROM c WHERE again""")
def recorded_stream(spark, d):
    """Conversations recorded as files of messages, read as a stream and taken in order; a turn delivered again is not accepted."""
    base = shared_dir(spark, "recorded")
    x = table(spark, d, "conversations").select("conv_id", "turn")
    x = x.withColumn("turn", F.explode(F.when(F.col("turn") % 4 == 3, F.array("turn", "turn")).otherwise(F.array("turn"))))
    lines = x.repartition(4, "conv_id").sortWithinPartitions("conv_id", "turn").select(F.to_json(F.struct("conv_id", "turn")).alias("value"))
    lines.write.text(f"{base}/messages")
    spark.dataSource.register(RecordedMessages)
    stream = spark.readStream.format("recorded_messages").option("path", f"{base}/messages").load()
    told = stream.withColumn("m", F.from_json("raw", "conv_id long, turn long")).select("m.*", "session_id", "message_index")
    return _drained(spark, states.ordered_ingest(told, ["conv_id"], "turn", ["session_id", "message_index"])).select("conv_id", "turn", "accepted")




FOLD_FEATURES = ["quantity", "discount", "tax"]


def fold_rows(spark, d):
    """Line items as labelled rows: what their discount and quantity foretell."""
    ts, signal = epoch(F.col("l_shipdate")), F.col("l_discount") * 10 + F.col("l_quantity") / 50 + F.col("l_partkey") % 17 / 17
    return table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("k"), ts.alias("ts"), (ts + DAY * (1 + F.col("l_linenumber"))).alias("available"), (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"),
        (F.col("l_tax") * 10 - 0.4).alias("score"), (signal > 1.4).cast("int").alias("y"), (1 + F.col("l_suppkey") % 4).cast("double").alias("w"), (F.col("l_discount") - F.col("l_tax")).alias("ret"),
    )


@query()
def purged_skill(spark, d):
    """What models learnt before each block of time foretell of it, against a score and the share of wins."""
    oof = crossfit.out_of_fold(fold_rows(spark, d), "k", "ts", "available", FOLD_FEATURES, "score", "y", "w", least=40)
    got = crossfit.skill(oof, "k", "y", "w", 40)
    return got.select("k", "status", "samples", "final_samples", *[r(c).alias(c) for c in ("feature_loss", "score_loss", "null_loss", "final_feature_loss", "final_score_loss", "final_null_loss")])


#: A contract in canonical form, and the JSON of reasons around it: the score floor alone varies.
_CONTRACT = "'{\"calibration\":{\"label_due_grace_sec\":60},\"selection\":{' || CASE WHEN o_orderkey % 13 <> 0 THEN '\"mean_reversion_min_score\":0.4,' ELSE '' END || '\"min_score_to_recommend\":0.' || (1 + o_orderkey % 3)::VARCHAR || '}}'"
_POLICY = """'{"feature_snapshot": {"mean_reversion_score": 0.' || d1 || ', "mean_reversion_evidence_valid": ' || CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE '1' END || ', "trend_strength": ' || CASE WHEN o_orderkey % 6 = 0 THEN '"no"' ELSE '0.' || d1 END || ', "trend_evidence_valid": true, "coherence": 0.7, "regime": "' || CASE WHEN o_orderkey % 10 = 7 THEN 'range' ELSE 'Trend ' END || '"},
"outcome_policy": {"policy_contract": ' || contract || ', "policy_fingerprint": "' || CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE '' END || hash || '", "policy_evaluation_eligible": ' || CASE WHEN o_orderkey % 5 = 0 THEN '"true"' ELSE 'true' END || ', "eligible": ' || CASE WHEN o_orderkey % 8 = 0 THEN 'false' ELSE 'true' END || ', "sample_role": "' || CASE WHEN o_orderkey % 3 = 0 THEN 'shadow_no_trade' ELSE 'live' END || '", "label_due_ts": ' || (ts + 3660 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END)::VARCHAR || '},
"execution_constraints": {' || CASE WHEN o_orderkey % 7 < 3 THEN '"raw_direction": "' || CASE WHEN o_orderkey % 7 = 0 THEN 'short' ELSE 'up' END || '"' ELSE '' END || '}, "risk_checks": {"blocks": [' || CASE WHEN o_orderkey % 9 = 0 THEN '{"code": "SPREAD"}, " SPREAD ", {"reason": "THIN"}, 5' ELSE '' END || ']}}'"""
_SPARK_POLICY = _POLICY.replace("::VARCHAR", "::STRING")
_J = lambda path: f"json_extract_string(j, '$.{path}')"
_ON = lambda path: f"coalesce(json_type(j, '$.{path}') = 'BOOLEAN' AND {_J(path)} = 'true', false)"


@query(f"""WITH o AS (SELECT o_orderkey, (o_orderkey % 10)::VARCHAR AS d1, epoch_us(o_orderdate) // 1000000 AS ts, CASE WHEN o_orderkey % 3 = 1 THEN 'directional_trend' ELSE 'futures_grid' END AS bot, CASE WHEN o_orderkey % 29 <> 0 THEN o_custkey % 10 / 10.0 END::DOUBLE AS score, CASE WHEN o_orderkey % 23 <> 0 THEN epoch_us(o_orderdate) // 1000000 + 3660 + o_orderkey % 5 - 1 END AS available, ['long', 'short', 'neutral', ''][1 + o_orderkey % 4] AS side, {_CONTRACT} AS contract FROM orders),
h AS (SELECT *, sha256(contract) AS hash FROM o), x AS (SELECT *, CASE WHEN o_orderkey % 31 <> 0 THEN ({_POLICY})::JSON END AS j, (SELECT max(hash) FROM h WHERE o_orderkey % 3 = 1 AND o_orderkey % 13 <> 0) AS active, 800000000 AS now FROM h),
p AS (SELECT *, bot = 'directional_trend' AS trending, try_cast({_J('feature_snapshot.mean_reversion_score')} AS DOUBLE) AS rev, coalesce(try_cast({_J('feature_snapshot.trend_strength')} AS DOUBLE) BETWEEN 0 AND 1, false) AS strong, coalesce({_J('feature_snapshot.coherence')} = '0.7', false) AS coherent, coalesce(lower(trim({_J('feature_snapshot.regime')})), '') AS regime, coalesce({_J('feature_snapshot.mean_reversion_evidence_valid')} = '1', false) AS reverts,
  try_cast({_J('outcome_policy.policy_contract.selection.min_score_to_recommend')} AS DOUBLE) AS floor, try_cast({_J('outcome_policy.policy_contract.selection.mean_reversion_min_score')} AS DOUBLE) AS least, {_ON('outcome_policy.policy_evaluation_eligible')} AS evaluated, {_ON('outcome_policy.eligible')} AS counted, {_J('outcome_policy.policy_fingerprint')} AS own, try_cast({_J('outcome_policy.label_due_ts')} AS BIGINT) AS said, ts + 3600 + CASE WHEN j IS NULL THEN 120 ELSE 60 END AS due FROM x),
q AS (SELECT *, strong AND coherent AND regime = 'trend' AS trends, coalesce(own = hash, false) AS verified, coalesce(own = active, false) AS match, coalesce(said = due AND available >= due, false) AS kept, coalesce(said IS NOT NULL AND available IS NOT NULL AND greatest(said, available) <= now, false) AS ripe, coalesce({_J('execution_constraints.raw_direction')}, nullif(side, ''), 'neutral') AS raw0 FROM p),
r AS (SELECT *, match AND verified AND evaluated AND coalesce(score >= floor, false) AND CASE WHEN trending THEN trends ELSE reverts AND coalesce(rev >= least, false) END AND kept AND ripe AS calibrates, CASE WHEN raw0 IN ('long', 'short', 'neutral') THEN raw0 ELSE 'neutral' END AS raw_direction, CASE WHEN side = '' THEN 'neutral' ELSE side END AS execution_direction FROM q)
SELECT o_orderkey, CASE WHEN NOT match THEN 'other_policy' WHEN calibrates THEN 'calibration_eligible' WHEN evaluated AND verified THEN 'policy_evaluation_candidate' WHEN counted AND {_J('outcome_policy.sample_role')} = 'shadow_no_trade' THEN 'shadow_exploration' WHEN counted THEN 'outcome_only' ELSE 'excluded' END AS cohort, calibrates AS calibration_eligible, match AND verified AS in_policy, raw_direction, execution_direction,
  CASE WHEN execution_direction <> 'neutral' THEN NULL WHEN raw_direction = 'short' THEN 'futures_neutral' WHEN raw_direction = 'neutral' THEN 'true_neutral' ELSE 'other_neutralized' END AS neutral_source,
  concat_ws(',', CASE WHEN NOT match THEN 'ACTIVE_POLICY_FINGERPRINT_MISMATCH' END, CASE WHEN NOT verified THEN 'POLICY_CONTRACT_UNVERIFIED' END, CASE WHEN NOT evaluated THEN 'POLICY_EVALUATION_EXCLUDED' END, CASE WHEN score IS NULL THEN 'SCORE_INVALID' END, CASE WHEN floor IS NULL THEN 'SCORE_POLICY_FLOOR_MISSING' END, CASE WHEN score < floor THEN 'SCORE_BELOW_POLICY_FLOOR' END,
   CASE WHEN trending AND NOT trends THEN 'TREND_EVIDENCE_INVALID' END, CASE WHEN trending AND NOT strong THEN 'TREND_STRENGTH_INVALID' END, CASE WHEN trending AND NOT coherent THEN 'TREND_COHERENCE_INVALID' END, CASE WHEN trending AND regime <> 'trend' THEN 'TREND_REGIME_MISMATCH' END, CASE WHEN NOT trending AND NOT reverts THEN 'MEAN_REVERSION_EVIDENCE_INVALID' END, CASE WHEN NOT trending AND least IS NULL THEN 'MEAN_REVERSION_POLICY_FLOOR_MISSING' END, CASE WHEN NOT trending AND reverts AND rev < least THEN 'MEAN_REVERSION_BELOW_POLICY_FLOOR' END,
   CASE WHEN said IS NULL THEN 'LABEL_DUE_MISSING' END, CASE WHEN said <> due THEN 'LABEL_DUE_CONTRACT_MISMATCH' END, CASE WHEN available IS NULL THEN 'LABEL_AVAILABILITY_MISSING' END, CASE WHEN available < due THEN 'LABEL_AVAILABILITY_PREMATURE' END, CASE WHEN NOT ripe THEN 'LABEL_NOT_MATURED' END, CASE WHEN (o_orderkey % 6 = 1) <> evaluated AND o_orderkey % 6 < 2 THEN 'MATERIALIZED_POLICY_ELIGIBILITY_MISMATCH' END, CASE WHEN j IS NOT NULL AND o_orderkey % 9 = 0 THEN 'SPREAD,THIN,5' END) AS codes FROM r""")
def exact_policy(spark, d):
    """Which orders, as labelled outcomes, count for the policy in force, and what keeps the others out."""
    k = F.col("o_orderkey")
    # A row's rules cost far more than to move it: rows are dealt over all tasks, however few groups of rows the file has.
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    o = o.withColumn("ts", epoch(F.col("o_orderdate"))).withColumn("d1", (k % 10).cast("string")).withColumn("contract", F.expr(_CONTRACT.replace("::VARCHAR", "::STRING")))
    o = o.withColumn("hash", F.sha2("contract", 256))
    active = o.where("o_orderkey % 3 = 1 and o_orderkey % 13 <> 0").agg(F.max("hash")).scalar()
    side = F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("neutral"), F.lit("")), (k % 4 + 1).cast("int"))
    x = o.select(
        "o_orderkey", "ts", "hash", F.when(k % 3 == 1, "directional_trend").otherwise("futures_grid").alias("bot"), F.when(k % 29 != 0, F.col("o_custkey") % 10 / 10.0).alias("score"), F.when(k % 23 != 0, F.col("ts") + 3660 + k % 5 - 1).alias("available"), side.alias("side"), X.variant(F.when(k % 31 != 0, F.expr(_SPARK_POLICY))).alias("v")
    )
    x = x.withColumn("active", active).withColumn("e", EL.evidence(F.col("v")))
    e, active = F.col("e"), F.col("active")
    got = EL.eligibility(e, F.col("bot"), F.col("score"), F.col("ts"), F.lit(3600), F.col("available"), {"policy": k % 6}, active, F.lit(800000000))
    inside = P.holds((e["own"] == active) & (e["contract"] == active))
    return x.select("o_orderkey", got["cohort"].alias("cohort"), got["calibration_eligible"].alias("calibration_eligible"), inside.alias("in_policy"), *[c.alias(n) for n, c in EL.directions(e, F.col("side"), F.lit(None).cast("string")).items()], F.array_join(got["reason_codes"], ",").alias("codes"))


@query()
def calibrator_gates(spark, d):
    """What keeps the calibrator of each key of line items from use."""
    x = fold_rows(spark, d).withColumn("raw", F.lit(0.6)).withColumn("adjustment", F.lit(0.9))
    got = calibrator.calibrator_gates(x, "k", "ts", "available", FOLD_FEATURES, "score", "y", "w", "ret", "raw", "adjustment", least=40)
    return got.select("k", "samples", "expectancy", r("mean").alias("mean"), "clusters", r("win_rate").alias("win_rate"), "balanced", "oof_samples", "skill", "selected", "terminal", "gate", "fitted")


@query()
def trend_event_models(spark, d):
    """Models of events of line items, judged on each key's last times."""
    x = fold_rows(spark, d)
    event = F.when(F.col("discount") > 0.6, "TP_FIRST").when(F.col("quantity") > 0.5, "SL_FIRST").otherwise("HORIZON_EXIT")
    got = calibrator.event_models(x.withColumn("event", event), "k", "ts", "available", DAY, FOLD_FEATURES, "event", ["TP_FIRST", "SL_FIRST", "HORIZON_EXIT"], "ret", "HORIZON_EXIT")
    return got.select("k", "status", "n_samples", "fit_samples", "holdout_samples", *[r(c).alias(c) for c in ("loss", "null_loss", "gap", "error_bound", "horizon_mean")])


@query("""WITH x AS (SELECT l_suppkey AS k, 10 + l_suppkey % 7 AS matured, 9 + l_suppkey % 5 AS labeled, l_suppkey % 4 AS censored, CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS unresolved, 0 AS invalid, CASE WHEN l_suppkey % 9 = 0 THEN 'negative' ELSE 'positive' END AS expectancy, count(*)::BIGINT AS samples, avg(l_discount) AS mean, stddev_pop(l_discount) / 20 AS std, min(l_discount) - 0.02::DOUBLE AS es FROM lineitem GROUP BY l_suppkey),
y AS (SELECT *, matured * 40 AS m, greatest(0, labeled * 40 - labeled * 40) AS z FROM x),
a AS (SELECT *, CASE WHEN expectancy = 'positive' THEN greatest(0, samples - m) ELSE 0 END + unresolved > 0 OR least(samples, labeled * 40) < labeled * 40 AND labeled * 40 > samples AS hard, censored / m AS rate, greatest(-1, least(-0.01::DOUBLE, es, mean - 3 * std)) AS assumed FROM y),
b AS (SELECT *, (mean * samples + assumed * censored) / (samples + censored) AS adjusted, NOT hard AND censored > 0 AND expectancy = 'positive' AS judged FROM a)
SELECT k, round(rate, 6) AS censoring_rate, round(CASE WHEN judged THEN assumed END, 6) AS assumed_return, round(CASE WHEN judged THEN adjusted END, 6) AS adjusted_mean, CASE WHEN hard THEN 'hard_block' WHEN NOT judged THEN 'not_evaluated' WHEN rate <= 0.05::DOUBLE AND adjusted > 0 AND mean - 0.01::DOUBLE > 0 THEN 'passed' ELSE 'failed' END AS sensitivity FROM b""")
def censoring_sensitivity(spark, d):
    """Whether a conclusion outlives the roots that could not be observed."""
    k = F.col("l_suppkey")
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("samples"), F.avg("l_discount").alias("mean"), (F.stddev_pop("l_discount") / 20).alias("std"), (F.min("l_discount") - 0.02).alias("shortfall"))
    x = x.select(
        k.alias("k"), "samples", "mean", "std", "shortfall", F.col("samples").cast("double").alias("n_eff"), (F.col("mean") - 0.01).alias("lower"), (F.col("mean") - 0.01).alias("temporal_lower"), ((10 + k % 7) * 40).alias("matured_total"), ((9 + k % 5) * 40).alias("labeled_total"), (k % 4).alias("censored_total"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("unresolved_total"), F.lit(0).alias("invalid_labeled_total"), F.when(k % 9 == 0, "negative").otherwise("positive").alias("expectancy"),
    )
    return calibrator.censoring(x).select("k", r("censoring_rate").alias("censoring_rate"), r("assumed_return").alias("assumed_return"), r("adjusted_mean").alias("adjusted_mean"), "sensitivity")
