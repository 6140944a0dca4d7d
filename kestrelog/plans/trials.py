"""Queries over samples, selection of detectors, packages as files, and reviewers' checks."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.operators import extra_trees, graph, hourly, incidents, metrics, selection, sequences, splits
from kestrelog.operators import verdicts as verdict_rules
from kestrelog.sources import adapters, packages

from .base import AUTH, query
from .detect import RECORDS, auth, queue, weighted_edges
from .history import HISTORY, RED_PART
from .review import CITED, cited, user_events, verdicts
from .units import CHUNKS, EX, HOURLY, LONGEST, MODELS, UNITS, counts, models, units

# ---- samples ----

_DRAW = "md5(acting_user || '/' || hour || '/' || chunk)"
_USES = {"train": ("split = 'train' AND status = 'available' AND touching_excluded = 0", 150), "monitor": ("split = 'validation' AND status = 'available'", 80)}


def _samples(spark, sf_dir):
    found = sequences.chunks(units(spark, sf_dir), LONGEST).join(units(spark, sf_dir).select("acting_user", "hour", "split", "status", "fits"), ["acting_user", "hour"])
    draw = F.md5(F.concat_ws("/", "acting_user", F.col("hour").cast("string"), F.col("chunk").cast("string")).cast("binary"))
    return selection.monitor_samples(found, 1, 150, 80, draw)


_SAMPLE = f"WITH {EX}, {UNITS}, {CHUNKS}, cu AS (SELECT c.acting_user, c.hour, c.chunk, c.length, u.split, u.status, u.touching_excluded, {_DRAW.replace('acting_user', 'c.acting_user').replace('hour', 'c.hour').replace('chunk', 'c.chunk')} AS draw FROM c JOIN u ON u.acting_user = c.acting_user AND u.hour = c.hour)"
for _use, (_cond, _k) in _USES.items():
    _SAMPLE += f", e_{_use} AS (SELECT * FROM cu WHERE {_cond}), d_{_use} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY acting_user, hour ORDER BY draw, chunk) AS n FROM e_{_use}) WHERE n <= 1 ORDER BY draw, acting_user, hour, chunk LIMIT {_k})"


@query("sequence_monitor_samples", _SAMPLE + " " + " UNION ALL ".join(f"SELECT '{u}' AS use, acting_user, hour, chunk FROM d_{u}" for u in _USES))
def _(spark, sf_dir):
    return _samples(spark, sf_dir)[0].select("use", "acting_user", "hour", "chunk")


@query("sequence_sample_accounting", _SAMPLE + " " + " UNION ALL ".join(
    f"SELECT '{u}' AS use, (SELECT count(DISTINCT (acting_user, hour)) FROM e_{u}) AS units, (SELECT count(*) FROM e_{u}) AS chunks, (SELECT CAST(sum(length) AS BIGINT) FROM e_{u}) AS events, (SELECT count(DISTINCT (acting_user, hour)) FROM d_{u}) AS sampled_units, (SELECT count(*) FROM d_{u}) AS sampled_chunks, (SELECT CAST(coalesce(sum(length), 0) AS BIGINT) FROM d_{u}) AS sampled_events" for u in _USES))
def _(spark, sf_dir):
    return _samples(spark, sf_dir)[1]


# ---- feature tables and fits ----


@query("graph_fitting_edges", f"WITH {AUTH}{RED_PART}, ex AS (SELECT DISTINCT user FROM red WHERE timestamp < 604801), fa AS (SELECT *, ((timestamp - 1) // 86400) * 86400 + 86401 AS window_end FROM auth WHERE source_user NOT IN (FROM ex) AND destination_user NOT IN (FROM ex) AND timestamp < 604801) SELECT window_end, acting_user, destination_computer, count(*) AS events FROM fa GROUP BY ALL")
def _(spark, sf_dir):
    """Windows of the training days without events that touch excluded users."""
    fit = splits.fitting_events(auth(spark, sf_dir), splits.excluded_users(adapters.red_team(spark, sf_dir))).where("timestamp < 604801")
    return graph.edges(graph.assign_windows(fit)).select("window_end", "acting_user", "destination_computer", "events")


SOURCES = HISTORY + """, us AS (SELECT acting_user, dataset_day, source_computer, count(*) AS n, bool_or(is_new_user_source) AS fresh, count(*) FILTER (is_new_host_connection) AS hosts FROM nov GROUP BY ALL),
pop AS (SELECT dataset_day, source_computer, count(*) AS users FROM us GROUP BY ALL), sg AS (SELECT acting_user, dataset_day, count(*) AS source_count, count(*) FILTER (fresh) AS new_source_count, CAST(coalesce(sum(n) FILTER (fresh), 0) AS BIGINT) AS new_source_auth_count, max(n) AS max_auth_per_source,
 min(users) AS min_source_popularity, round(avg(users), 6) AS mean_source_popularity, CAST(sum(hosts) AS BIGINT) AS new_host_connection_events FROM us JOIN pop USING (dataset_day, source_computer) GROUP BY ALL), dn AS (SELECT acting_user, dataset_day, count(DISTINCT destination_computer) AS destination_count FROM nov GROUP BY ALL)"""


@query("graph_source_features", f"WITH {SOURCES} SELECT sg.*, CAST(coalesce(sum(new_source_count) OVER (PARTITION BY acting_user ORDER BY dataset_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_source_degree, destination_count FROM sg JOIN dn USING (acting_user, dataset_day)")
def _(spark, sf_dir):
    return selection.source_features(auth(spark, sf_dir)).withColumn("mean_source_popularity", F.round("mean_source_popularity", 6))


def user_days(spark, sf_dir):
    """The 19 inputs of user-days, stored, since several fits read them."""
    log, keys = tables.stored(auth(spark, sf_dir).select("timestamp", "source_line", "acting_user", "source_computer", "destination_computer", "authentication_result", "dataset_day"), "log"), ["acting_user", "window_end"]
    e = tables.stored(weighted_edges(spark, sf_dir, log).drop("lines"), "edges")  # lines are not put in order then
    scores = graph.user_scores(e).select(*keys, F.col("max_score").alias("baseline_score"))
    peaks = tables.stored(graph.bursts(graph.assign_windows(log)), "peaks")
    degrees = graph.degrees(e, graph.prior_degrees(log)).select(*keys, F.col("degree").alias("current_degree"), "prior_degree", F.col("growth").alias("degree_growth"))
    edges = e.groupBy(*keys).agg(F.count("*").alias("n_edges"), F.count_if("is_new").alias("new_edge_count"))
    burst = metrics.calibrate(peaks.withColumn("score", F.col("peak_destinations_300s").cast("double")), metrics.fit_calibrator(peaks.select(F.col("peak_destinations_300s").cast("double").alias("score"))), name="burst_score").drop("score")
    days = scores.join(burst, keys).join(degrees, keys).join(edges, keys).withColumn("dataset_day", (F.floor((F.col("window_end") - 2) / 86_400) + 1).cast("int"))
    return days.join(selection.source_features(log), ["acting_user", "dataset_day"]).withColumns({"user": F.col("acting_user"), "day": F.col("dataset_day")})


@query("graph_supervised_comparison")
def _(spark, sf_dir):
    """Four classifiers on user-days: fitted on days 8 to 12, chosen by average precision and F1 on 13 to 16, threshold frozen for later days."""
    labels = adapters.red_team(spark, sf_dir).select("user", splits.day_of(F.col("timestamp")).alias("day"))
    rows = tables.stored(metrics.label_units(user_days(spark, sf_dir), labels, ["user", "day"]), "user-days")
    inputs = [*selection.SCORES, *selection.COUNTS]
    candidates = {
        "logistic": selection.spark_classifier(LogisticRegression(maxIter=30)),
        "forest": selection.spark_classifier(RandomForestClassifier(numTrees=20, maxDepth=4, seed=7)),
        "boosted": selection.spark_classifier(GBTClassifier(maxIter=5, maxDepth=3, seed=7)),
        "extra_trees": selection.tree_classifier(inputs, extra_trees.Settings(trees=20, depth=6)),
    }
    found = selection.compare_classifiers(selection.feature_matrix(rows), candidates)
    return found.withColumns({c: F.round(c, 6) for c in ("threshold", "precision", "recall", "f1", "fpr", "ap", "auc")})


# ---- extremely randomised trees over the source inputs of user-days ----

TREES, TREE_DEPTH, LEAST = 6, 4, 3
TREE_INPUTS = ["source_count", "new_source_count", "new_source_auth_count", "max_auth_per_source", "min_source_popularity", "new_host_connection_events"]


def tree_days(spark, sf_dir):
    labels = adapters.red_team(spark, sf_dir).select("user", splits.day_of(F.col("timestamp")).alias("day"))
    days = selection.source_features(auth(spark, sf_dir)).withColumns({"user": F.col("acting_user"), "day": F.col("dataset_day")})
    return tables.stored(metrics.label_units(days, labels, ["user", "day"]), "tree-days")


def _tree_sql() -> str:
    """The trees level by level: ranges, cuts, counts of sides and the best cut of each are a query each."""
    m = len(TREE_INPUTS)
    u = lambda what, f: f"((CAST('0x' || substr(md5('42/{what}/' || tree || '/' || node || '/{f}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"
    pure = lambda n, pos: f"(((w0 * ({n} - {pos})) * (w0 * ({n} - {pos})) + (w1 * ({pos})) * (w1 * ({pos}))) / ((w0 * ({n} - {pos})) + (w1 * ({pos}))))"
    parts = [
        SOURCES[len(AUTH):],
        "lab AS (SELECT DISTINCT user, CAST((timestamp - 1) // 86400 + 1 AS INTEGER) AS day FROM red)",
        f"td AS (SELECT sg.acting_user, sg.dataset_day, lab.user IS NOT NULL AS label, {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(TREE_INPUTS))} FROM sg LEFT JOIN lab ON lab.user = sg.acting_user AND lab.day = sg.dataset_day)",
        "fit AS (SELECT * FROM td WHERE dataset_day BETWEEN 8 AND 12)",
        "cw AS (SELECT count(*) / (2.0 * greatest(count(*) - count(*) FILTER (label), 1)) AS w0, count(*) / (2.0 * greatest(count(*) FILTER (label), 1)) AS w1 FROM fit)",
        f"a0 AS MATERIALIZED (SELECT unnest(range(0, {TREES})) AS tree, CAST(1 AS BIGINT) AS node, label, {', '.join(f'x{i}' for i in range(m))} FROM fit)",
    ]
    for d in range(TREE_DEPTH):
        parts += [
            f"n{d} AS MATERIALIZED (SELECT tree, node, count(*) AS n, count(*) FILTER (label) AS pos, {', '.join(f'min(x{i}) AS lo{i}, max(x{i}) AS hi{i}' for i in range(m))} FROM a{d} GROUP BY ALL)",
            f"o{d} AS (" + " UNION ALL ".join(f"SELECT tree, node, n, pos, {i} AS f, lo{i} AS lo, hi{i} AS hi, {u('order', i)} AS r, {u('cut', i)} AS v FROM n{d} WHERE pos > 0 AND pos < n AND n >= {2 * LEAST} AND hi{i} > lo{i}" for i in range(m)) + ")",
            f"k{d} AS MATERIALIZED (SELECT *, CASE WHEN lo + (hi - lo) * v < hi THEN lo + (hi - lo) * v ELSE lo END AS cut FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY r, f) AS place FROM o{d}) WHERE place <= {-(-4 * m // 5)})",
            f"s{d} AS (" + " UNION ALL ".join(f"SELECT k.tree, k.node, k.n, k.pos, k.f, k.cut, count(*) FILTER (a.x{i} <= k.cut) AS ln, count(*) FILTER (a.x{i} <= k.cut AND a.label) AS lp FROM k{d} k JOIN a{d} a ON a.tree = k.tree AND a.node = k.node WHERE k.f = {i} GROUP BY ALL" for i in range(m)) + ")",
            f"b{d} AS MATERIALIZED (SELECT tree, node, f, cut FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY round({pure('ln', 'lp')} + {pure('(n - ln)', '(pos - lp)')}, 9) DESC, f) AS place FROM s{d}, cw WHERE ln >= {LEAST} AND n - ln >= {LEAST}) WHERE place = 1)",
            f"a{d + 1} AS MATERIALIZED (SELECT a.tree, 2 * a.node + CAST(CASE b.f {' '.join(f'WHEN {i} THEN a.x{i}' for i in range(m))} END > b.cut AS INTEGER) AS node, label, {', '.join(f'x{i}' for i in range(m))} FROM a{d} a JOIN b{d} b ON a.tree = b.tree AND a.node = b.node)",
        ]
    parts.append(f"n{TREE_DEPTH} AS (SELECT tree, node, count(*) AS n, count(*) FILTER (label) AS pos FROM a{TREE_DEPTH} GROUP BY ALL)")
    level = lambda d: f"SELECT n{d}.tree, n{d}.node, n, pos, f, cut FROM n{d} LEFT JOIN b{d} ON b{d}.tree = n{d}.tree AND b{d}.node = n{d}.node"
    parts.append("trees AS MATERIALIZED (" + " UNION ALL ".join([*map(level, range(TREE_DEPTH)), f"SELECT tree, node, n, pos, NULL, NULL FROM n{TREE_DEPTH}"]) + ")")
    return f"WITH {AUTH}{RED_PART}" + ", ".join(parts)


_TREE_SQL = _tree_sql()


@query("graph_extra_trees", _TREE_SQL + " SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, n, pos, CAST(f AS INTEGER) AS feature, round(cut, 6) AS cut, round(w1 * pos / (w0 * (n - pos) + w1 * pos), 6) AS value FROM trees, cw")
def _(spark, sf_dir):
    """The nodes of trees grown on days 8 to 12."""
    grown = extra_trees.grow(tree_days(spark, sf_dir).where("day between 8 and 12"), TREE_INPUTS, extra_trees.Settings(TREES, TREE_DEPTH, LEAST))
    return grown.withColumns({c: F.round(c, 6) for c in ("cut", "value")})


def _walk_sql() -> str:
    m = len(TREE_INPUTS)
    parts = [f"p0 AS (SELECT acting_user, dataset_day, {', '.join(f'x{i}' for i in range(m))}, unnest(range(0, {TREES})) AS tree, CAST(1 AS BIGINT) AS node FROM td WHERE dataset_day > 12)"]
    for d in range(TREE_DEPTH):
        parts.append(f"p{d + 1} AS (SELECT p.* REPLACE (CASE WHEN t.f IS NULL THEN p.node ELSE 2 * p.node + CAST(CASE t.f {' '.join(f'WHEN {i} THEN p.x{i}' for i in range(m))} END > t.cut AS INTEGER) END AS node) FROM p{d} p LEFT JOIN trees t ON t.tree = p.tree AND t.node = p.node AND t.f IS NOT NULL)")
    return _TREE_SQL + ", " + ", ".join(parts) + f" SELECT acting_user AS user, dataset_day AS day, round(avg(w1 * t.pos / (w0 * (t.n - t.pos) + w1 * t.pos)), 6) AS score FROM p{TREE_DEPTH} p JOIN trees t ON t.tree = p.tree AND t.node = p.node, cw GROUP BY ALL"


@query("graph_extra_tree_scores", _walk_sql())
def _(spark, sf_dir):
    """Scores of later user-days under the trees."""
    days = tree_days(spark, sf_dir)
    grown = extra_trees.grow(days.where("day between 8 and 12"), TREE_INPUTS, extra_trees.Settings(TREES, TREE_DEPTH, LEAST))
    return extra_trees.scores(days.where("day > 12"), ["user", "day"], TREE_INPUTS, grown).withColumn("score", F.round("score", 6))


@query("graph_grid")
def _(spark, sf_dir):
    """Trials of window, factors and aggregation by average precision on days 8 to 16, the best marked; edges of days 2 to 7 are fitted on."""
    out = None
    labels = tables.stored(adapters.red_team(spark, sf_dir).select("timestamp", "user"), "labels")
    log = tables.stored(auth(spark, sf_dir).select("timestamp", "acting_user", "destination_computer", "authentication_result"), "log")
    fitted = f"window_end <= {7 * 86_400 + 1}"
    for width in (43_200, 86_400):
        w = graph.assign_windows(log, width, 43_200 if width == 43_200 else 86_400)
        # windows after the last held one have no part in the trials; edges are numbered once for both ranks
        e = tables.stored(graph.edge_weights(w.where(f"window_end <= {16 * 86_400 + 1}")), "grid-weights")
        e = tables.stored(*graph.indexed(e.where(fitted), e), "grid-edges")
        positives = labels.select("user", graph.label_cutoff(F.col("timestamp"), width).alias("window_end"))
        for rank in (4, 8):
            scored = graph.user_scores(graph.indexed_anomaly(e.where(fitted), e.where(f"not {fitted}"), rank))
            scored = scored.select(F.col("acting_user").alias("user"), "window_end", "max_score", "top_mean")
            part = tables.stored(metrics.label_units(scored, positives, ["user", "window_end"]), "grid-scores")
            for aggregation in ("max_score", "top_mean"):
                row = part.select(F.lit(width).alias("window"), F.lit(rank).alias("factors"), F.lit(aggregation).alias("aggregation"), "label", F.col(aggregation).alias("score"))
                out = row if out is None else out.union(row)
    keys = ["window", "factors", "aggregation"]
    ap = metrics.average_precision(out, keys)
    return ap.withColumns({"ap": F.round("ap", 6), "chosen": F.row_number().over(Window.orderBy(F.desc_nulls_last("ap"), *keys)) == 1})  # a row for each trial


@query("baseline_threshold_evaluation")
def _(spark, sf_dir):
    """Isolation trees of days 2 to 7, threshold from days 8 to 12, figures of days 13 to 16."""
    c = tables.stored(counts(spark, sf_dir), "hourly-counts")
    trees = hourly.grow_trees(c.where("day between 2 and 7"), hourly.COUNTS)
    scored = hourly.isolation_scores(c.select("acting_user", "hour", "day", "tie", "is_machine", *hourly.COUNTS), trees, hourly.COUNTS).withColumn("user", F.col("acting_user"))
    rows = metrics.label_units(scored, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])
    found = selection.threshold_evaluation(tables.stored(rows.select("user", "hour", "day", "tie", "is_machine", "label", F.round("score", 6).alias("score")), "forest-scores"), 38)
    return found.withColumns({c: F.round(c, 6) for c in ("threshold", "ap")})


def _labelled_counts(spark, sf_dir):
    c = counts(spark, sf_dir).withColumn("user", F.col("acting_user"))
    rows = metrics.label_units(c, splits.label_hours(adapters.red_team(spark, sf_dir)), ["user", "hour"])
    return tables.stored(rows.select("user", "hour", "day", "label", "tie", *hourly.COUNTS), "labelled-counts")


@query("supervised_permutation_importance")
def _(spark, sf_dir):
    """What a fitted logistic model loses when each of its inputs changes places, over five seeds."""
    rows = _labelled_counts(spark, sf_dir)
    score = selection.fitted(rows, hourly.COUNTS, LogisticRegression(labelCol="y", weightCol="weight", maxIter=50))
    found = selection.permutation_importance(rows, hourly.COUNTS, score)
    return found.select("feature", F.round("loss", 6).alias("loss"), F.round("deviation", 6).alias("deviation"))


@query("supervised_noise_stability")
def _(spark, sf_dir):
    """Seven fits, each with other noise on one input score."""
    hs = adapters.hour_scores(spark, sf_dir).select("user", "hour", "graph_score", "seq_score")
    rows = tables.stored(_labelled_counts(spark, sf_dir).join(hs, ["user", "hour"]), "noise-rows")
    found = selection.noise_stability(rows, "seq_score", ["seq_score", "graph_score", *hourly.COUNTS], LogisticRegression(labelCol="y", weightCol="weight", maxIter=30))
    return found.withColumns({c: F.round(c, 6) for c in ("median", "least", "largest")})


_RULES = MODELS + """, hm AS (SELECT user, day, 'graph_humans' AS model, CASE WHEN is_machine THEN -1.0 ELSE score END AS score, tie, label FROM md WHERE model = 'graph'), al AS (SELECT user, day, model, CAST(score AS DOUBLE) AS score, tie, label FROM md UNION ALL SELECT * FROM hm),
tp AS (SELECT *, row_number() OVER (PARTITION BY model, day ORDER BY score DESC, tie) AS rank FROM al), hi AS (SELECT model, count(*) FILTER (rank <= 38 AND label) AS hits FROM tp GROUP BY 1), g3 AS (SELECT model, score, count(*) FILTER (label) AS pos, count(*) FILTER (NOT label) AS neg FROM al GROUP BY ALL),
c3 AS (SELECT *, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY model) AS P FROM g3 WINDOW o AS (PARTITION BY model ORDER BY score DESC)), ap AS (SELECT model AS scorer, round(sum(pos * tp / (tp + fp)) / max(P), 6) AS ap FROM c3 GROUP BY 1), sc3 AS (SELECT scorer, hits, ap FROM ap JOIN hi ON hi.model = scorer)"""


@query("metrics_success_rules", f"WITH {_RULES} SELECT s.scorer, s.hits, s.ap, greatest(2 * r.hits, 2) AS needed, s.hits >= greatest(2 * r.hits, 2) AND s.ap > r.ap AS primary, s.hits > h.hits AND s.ap > h.ap AS secondary FROM sc3 s, sc3 r, sc3 h WHERE r.scorer = 'graph' AND h.scorer = 'graph_humans'")
def _(spark, sf_dir):
    m = models(spark, sf_dir).select("user", "hour", "day", "model", F.col("score").cast("double").alias("score"), "tie", "label", "is_machine")
    humans = m.where("model = 'graph'").withColumns({"model": F.lit("graph_humans"), "score": F.when(F.col("is_machine"), -1.0).otherwise(F.col("score"))})
    rows = m.union(humans)
    hits = metrics.budget_metrics(rows, 38, ["tie"], ["model"]).select("model", "hits")
    per = hits.join(metrics.average_precision(rows, ["model"]), "model").select(F.col("model").alias("scorer"), "hits", F.round("ap", 6).alias("ap"))
    return selection.success_rules(tables.stored(per, "scorers"), "graph", "graph_humans").select("scorer", "hits", "ap", F.col("needed").cast("long").alias("needed"), "primary", "secondary")


# ---- packages as files ----


def _package(spark, sf_dir):
    q = tables.stored(queue(spark, sf_dir), "queue")
    events = incidents.alert_events(q, auth(spark, sf_dir)).select("alert_id", "source_line", "timestamp", "acting_user", "hour")
    inc = incidents.records(q, auth(spark, sf_dir), "validation").select("incident_id", "user", "start", "end", "priority", F.lit(None).cast("double").alias("max_score"), "references")
    return q, events, inc


@query("incidents_json_lines", f"WITH {RECORDS} SELECT format('INC-VALIDATION-D{{:02d}}-{{}}-{{:03d}}', day, replace(replace(user, '@', '_'), '$', ''), CAST(incident_seq AS BIGINT)) AS incident_id, user, start, end_ AS \"end\", priority, CAST(NULL AS DOUBLE) AS max_score, refs AS \"references\" FROM rc JOIN rf USING (user, incident_seq)")
def _(spark, sf_dir):
    """Incidents written as JSON lines and read back through the checks."""
    path = tables.fresh_path(spark, "incidents")
    packages.write_incidents(_package(spark, sf_dir)[2], path)
    return packages.read_incidents(spark, path)


@query("incidents_json_problems", f"WITH {RECORDS}, i AS (SELECT format('INC-VALIDATION-D{{:02d}}-{{}}-{{:03d}}', day, replace(replace(user, '@', '_'), '$', ''), CAST(incident_seq AS BIGINT)) AS incident_id, user, start FROM rc) SELECT incident_id, 'bad_range' AS problem FROM i WHERE start % 7 = 0 UNION ALL SELECT incident_id, 'bad_priority' FROM i WHERE start % 7 = 1 UNION ALL SELECT NULL, 'no_incident_id' FROM i WHERE start % 7 = 2 UNION ALL SELECT incident_id, 'duplicate_incident_id' FROM i WHERE start % 7 = 3")
def _(spark, sf_dir):
    """The problems of a file with planted ones."""
    path, kind = tables.fresh_path(spark, "incidents"), F.col("start") % 7
    inc = tables.stored(_package(spark, sf_dir)[2], "incidents")
    bad = inc.withColumns({"end": F.when(kind == 0, F.col("start")).otherwise(F.col("end")), "priority": F.when(kind == 1, "URGENT").otherwise(F.col("priority")), "incident_id": F.when(kind == 2, " ").otherwise(F.col("incident_id"))})
    packages.write_incidents(bad.union(inc.where(kind == 3)), path)
    return packages.incident_problems(spark, path).select(F.when(F.trim("incident_id") != "", F.col("incident_id")).alias("incident_id"), "problem")


@query("incidents_package_files", f"WITH {RECORDS} SELECT (SELECT count(*) FROM q) AS alerts, (SELECT count(*) FROM al) AS events, (SELECT count(*) FROM rc) AS incidents, (SELECT count(*) FROM rc) AS distinct_ids, CAST(0 AS BIGINT) AS unresolved")
def _(spark, sf_dir):
    """The three outputs of a package, written and read back."""
    path = tables.fresh_path(spark, "package")
    packages.write_package(*_package(spark, sf_dir), path, "validation")
    return packages.package_summary(spark, path)


# ---- reviewers ----


@query("replies_label_problems", f"""WITH {CITED}, s9 AS (SELECT DISTINCT incident_id FROM vd), n9 AS (SELECT row_number() OVER (ORDER BY incident_id, technique) AS row, * FROM vd),
r9 AS (SELECT row, CASE WHEN row % 41 = 0 THEN 'INC-NONE' ELSE incident_id END AS incident_id, CASE WHEN row % 43 = 0 THEN 'Maybe' WHEN row % 7 = 0 AND incident_id LIKE '%1@%' THEN 'No supported mapping' WHEN verdict = 'Supported' THEN 'Supported' ELSE 'Uncertain' END AS judgement, CASE WHEN row % 47 = 0 THEN 'T12' WHEN row % 14 = 0 AND incident_id LIKE '%1@%' THEN '' ELSE technique END AS technique FROM n9 WHERE incident_id NOT LIKE 'U9%'),
k9 AS (SELECT r9.*, s9.incident_id IS NOT NULL AS known FROM r9 LEFT JOIN s9 USING (incident_id)), p9 AS (SELECT *, CASE WHEN NOT known THEN 'unknown_incident' WHEN judgement = 'Maybe' THEN 'bad_judgement' WHEN judgement = 'No supported mapping' AND technique <> '' THEN 'technique_without_mapping' WHEN judgement <> 'No supported mapping' AND NOT regexp_full_match(technique, 'T[0-9]{{4}}([.][0-9]{{3}})?') THEN 'malformed_technique' END AS problem FROM k9),
c9 AS (SELECT * FROM p9 WHERE problem IS NULL OR problem = 'technique_without_mapping')
SELECT row, incident_id, problem FROM p9 WHERE problem IS NOT NULL UNION ALL SELECT NULL, incident_id, 'mixes_mapping_and_none' FROM c9 GROUP BY incident_id HAVING bool_or(judgement = 'No supported mapping') AND bool_or(judgement <> 'No supported mapping')
UNION ALL SELECT NULL, incident_id, 'supported_and_uncertain' FROM (SELECT DISTINCT incident_id FROM (SELECT incident_id, technique FROM c9 WHERE judgement <> 'No supported mapping' GROUP BY ALL HAVING count(DISTINCT judgement) > 1))
UNION ALL SELECT NULL, incident_id, 'without_label' FROM s9 WHERE incident_id NOT IN (SELECT incident_id FROM c9 UNION SELECT incident_id FROM k9 WHERE known AND judgement IN ('Supported', 'Uncertain'))""")
def _(spark, sf_dir):
    """Label rows made of the verdicts, with planted mistakes."""
    v = tables.stored(verdicts(spark, sf_dir), "verdicts")
    n = v.withColumn("row", F.row_number().over(Window.orderBy("incident_id", "technique")).cast("long"))  # a reviewer's table
    row, one = F.col("row"), F.col("incident_id").like("%1@%")
    rows = n.where(~F.col("incident_id").startswith("U9")).select(
        "row", F.when(row % 41 == 0, "INC-NONE").otherwise(F.col("incident_id")).alias("incident_id"),
        F.when(row % 43 == 0, "Maybe").when((row % 7 == 0) & one, "No supported mapping").when(F.col("verdict") == "Supported", "Supported").otherwise("Uncertain").alias("judgement"),
        F.when(row % 47 == 0, "T12").when((row % 14 == 0) & one, "").otherwise(F.col("technique")).alias("technique"),
    )
    return verdict_rules.label_problems(rows, v.select("incident_id"))


_MODES = ["plain", "rag"]
_GEN = CITED + ", gi AS (SELECT DISTINCT incident_id FROM vd), ge AS (SELECT incident_id, m AS mode, CASE WHEN length(incident_id) % 2 = 0 AND m = 'rag' THEN 'blocked' ELSE 'ok' END AS status FROM gi, (VALUES ('plain'), ('rag')) v(m) WHERE NOT (m = 'rag' AND incident_id LIKE '%3@%')), oc AS (SELECT incident_id, CASE WHEN bool_or(verdict = 'Supported') THEN 'supported_mapping' WHEN bool_or(verdict = 'Uncertain') THEN 'uncertain_mapping' ELSE 'no_supported_mapping' END AS outcome FROM vd GROUP BY 1)"


def _generated(v):
    modes = F.explode(F.array(*map(F.lit, _MODES))).alias("mode")
    g = v.select("incident_id").distinct().select("incident_id", modes).where(~((F.col("mode") == "rag") & F.col("incident_id").like("%3@%")))
    return g.withColumn("status", F.when((F.length("incident_id") % 2 == 0) & (F.col("mode") == "rag"), "blocked").otherwise("ok"))


@query("replies_per_mode", f"WITH {_GEN} SELECT gi.incident_id, m AS mode, CASE WHEN m = 'rag' AND gi.incident_id LIKE '%3@%' THEN 'pending' WHEN m = 'rag' AND length(gi.incident_id) % 2 = 0 THEN 'blocked' ELSE 'ok' END AS status, CASE WHEN m = 'plain' THEN outcome END AS outcome FROM gi, (VALUES ('plain'), ('rag')) v(m), oc WHERE oc.incident_id = gi.incident_id")
def _(spark, sf_dir):
    v = tables.stored(verdicts(spark, sf_dir), "verdicts")
    checked = verdict_rules.outcomes(v).select("incident_id", F.lit("plain").alias("mode"), "outcome")
    return verdict_rules.per_mode(_generated(v), checked, v.select("incident_id"), _MODES)


@query("replies_run_summary", f"WITH {_GEN}, vm AS (SELECT 'plain' AS mode, count(*) AS mapped, count(DISTINCT technique) AS techniques, count(DISTINCT incident_id) AS with_techniques, count(*) FILTER (verdict = 'Supported') AS supported, count(*) FILTER (verdict = 'Uncertain') AS uncertain, count(*) FILTER (verdict = 'Rejected') AS rejected FROM vd) SELECT ge.mode, count(*) AS replies, count(*) FILTER (status = 'ok') AS ok, coalesce(any_value(mapped), 0) AS mapped, coalesce(any_value(techniques), 0) AS techniques, coalesce(any_value(with_techniques), 0) AS with_techniques, coalesce(any_value(supported), 0) AS supported, coalesce(any_value(uncertain), 0) AS uncertain, coalesce(any_value(rejected), 0) AS rejected FROM ge LEFT JOIN vm ON vm.mode = ge.mode GROUP BY ge.mode")
def _(spark, sf_dir):
    v = tables.stored(verdicts(spark, sf_dir), "verdicts")
    return verdict_rules.run_summary(_generated(v), v.withColumn("mode", F.lit("plain")))


@query("replies_linked_techniques", f"WITH {CITED}, gr AS (SELECT incident_id, day AS \"group\", list(source_line) AS lines FROM ue GROUP BY ALL), te AS (SELECT incident_id, technique, list(source_line) AS cited FROM ci GROUP BY ALL), m AS (SELECT incident_id, \"group\", string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM gr JOIN te USING (incident_id) WHERE list_has_any(lines, cited) GROUP BY ALL) SELECT incident_id, \"group\", coalesce(techniques, '') AS techniques FROM gr LEFT JOIN m USING (incident_id, \"group\")")
def _(spark, sf_dir):
    e = user_events(spark, sf_dir)
    groups = e.groupBy("incident_id", F.col("day").alias("group")).agg(F.collect_list("source_line").alias("lines"))
    mapped = cited(e).groupBy("incident_id", "technique").agg(F.collect_list("source_line").alias("lines"))
    return verdict_rules.link_techniques(groups, mapped)
