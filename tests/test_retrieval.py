from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from kestrelog.operators import catalogue, packed, retrieval


def objects():
    ref = lambda x: [{"source_name": "elsewhere", "external_id": "E"}, {"source_name": "mitre-attack", "external_id": x, "url": f"http://t/{x}"}]
    log = lambda *c: [{"x_mitre_data_component_ref": f"comp--{x}", "name": "Win", **({"channel": "4624"} if x == 1 else {})} for x in c]
    chain = [{"kill_chain_name": "mitre-attack", "phase_name": p} for p in ("persist", "enter")] + [{"kill_chain_name": "mobile", "phase_name": "a"}]
    return [
        {"type": "x-mitre-collection", "id": "col--1", "name": "All", "x_mitre_version": "3.0"},
        {"type": "attack-pattern", "id": "ap--1", "name": "Guess", "description": "Try  words.(Citation: A b)\n\nSee [this](http://x) now (Citation: C) ", "external_references": ref("T1001"), "kill_chain_phases": chain, "x_mitre_platforms": ["win", "linux"]},
        {"type": "attack-pattern", "id": "ap--2", "name": "Old", "external_references": ref("T1002"), "revoked": True},
        {"type": "attack-pattern", "id": "ap--3", "name": "Older", "external_references": ref("T1002.001"), "x_mitre_deprecated": True},
        {"type": "attack-pattern", "id": "ap--4", "name": "Ticket", "external_references": ref("T1004.001"), "x_mitre_is_subtechnique": True},
        {"type": "attack-pattern", "id": "ap--5", "name": "Quiet", "external_references": ref("T1005")},
        *[{"type": "component", "id": f"comp--{i}", "name": n} for i, n in ((1, "Logon Session Creation"), (2, "File"), (3, "Active Directory Credential Request"))],
        {"type": "analytic", "id": "an--1", "x_mitre_log_source_references": log(1, 2, 9)},
        {"type": "analytic", "id": "an--2", "x_mitre_log_source_references": log(3)},
        {"type": "analytic", "id": "an--3", "x_mitre_deprecated": True, "x_mitre_log_source_references": log(3)},
        {"type": "strategy", "id": "st--1", "x_mitre_analytic_refs": ["an--1", "an--3", "an--none"]},
        {"type": "strategy", "id": "st--2", "x_mitre_analytic_refs": ["an--2"]},
        {"type": "strategy", "id": "st--3", "revoked": True, "x_mitre_analytic_refs": ["an--2"]},
        *[{"type": "relationship", "id": f"r--{k}", "relationship_type": kind, "source_ref": a, "target_ref": b, **x} for k, (kind, a, b, x) in enumerate([("detects", "st--1", "ap--1", {}), ("detects", "st--2", "ap--4", {}), ("detects", "st--3", "ap--5", {}), ("uses", "st--2", "ap--5", {}), ("detects", "st--2", "ap--5", {"revoked": True})])],
    ]


def test_bundle_and_lines_give_one_catalogue(spark, tmp_path):
    (tmp_path / "bundle.json").write_text(json.dumps({"type": "bundle", "objects": objects()}, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, objects())))
    for read, name in ((catalogue.read_bundle, "bundle.json"), (catalogue.read_objects, "lines.json")):
        given = read(spark, str(tmp_path / name))
        assert tuple(catalogue.collection_info(given).first()) == ("All", "3.0", None)
        rows = {r.technique: r for r in catalogue.extract_techniques(given).collect()}
        assert set(rows) == {"T1001", "T1004.001", "T1005"}
        one = rows["T1001"]
        assert one.description == "Try words.\n\nSee this now" and one.tactics == ["enter", "persist"] and one.platforms == ["linux", "win"] and one.url == "http://t/T1001" and one.parent is None
        assert one.data_components == ["File", "Logon Session Creation"] and one.log_sources == ["Win", "Win 4624"]
        assert rows["T1004.001"].parent == "T1004" and rows["T1004.001"].is_subtechnique and rows["T1005"].data_components == []
        assert {r.technique for r in catalogue.observable(catalogue.extract_techniques(given)).collect()} == {"T1001", "T1004.001"}


def test_malformed_bundles_are_refused(spark, tmp_path):
    for k, change in enumerate([lambda x: x[1]["external_references"].pop(), lambda x: x[1]["external_references"][1].update(external_id="X1"), lambda x: x[5]["external_references"][1].update(external_id="T1001")]):
        given = objects()
        change(given)
        path = tmp_path / f"{k}.json"
        path.write_text("\n".join(map(json.dumps, given)))
        with pytest.raises(ValueError):
            catalogue.extract_techniques(catalogue.read_objects(spark, str(path)))
    with pytest.raises(ValueError):
        catalogue.collection_info(catalogue.read_objects(spark, str(path)).where("type <> 'x-mitre-collection'"))


def slow_terms(text, stop):
    w = [x for x in re.findall(r"\w\w+", text.lower()) if x not in stop]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def slow_search(docs, queries, stop, k, least):
    counts = {i: slow_terms(t, stop) for i, t in docs}
    seen = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in seen.items()}

    def unit(c):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    index, out = {i: unit(c) for i, c in counts.items()}, {}
    for q, text in queries:
        u = unit(slow_terms(text, stop))
        scored = sorted((-round(sum(x * d.get(t, 0) for t, x in u.items()), 6), i) for i, d in index.items())
        out[q] = [(i, -s) for s, i in scored if -s >= least][:k]
    return out


def test_search_equals_scoring_everything(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["the", "of", "straße", "été", "x"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(250)]
    docs += [(900, docs[3][1]), (901, docs[3][1])]  # ties
    queries = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for q in range(60)] + [(99, docs[3][1]), (98, "unknown words alone"), (97, "")]
    index = retrieval.build(spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "ix"), retrieval.ENGLISH)
    asked = spark.createDataFrame(queries, "query long, text string")
    leads = retrieval.split_terms(retrieval.query_terms(index, asked), 0.1)
    assert leads.where("not leads").count() > 20 < leads.where("leads").count()  # both parts are used
    again = retrieval.Index.read(spark, str(tmp_path / "ix"), retrieval.ENGLISH)
    for k, least in ((3, 0.1), (5, 0.3), (400, 0.0001)):
        got = {}
        for r in sorted(retrieval.search(again, asked, k, least).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query, []).append((r.id, r.score))
        want = {q: x for q, x in slow_search(docs, queries, set(retrieval.ENGLISH), k, least).items() if x}
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got[q], want[q]))
    plan = again.postings.where("term in ('w1', 'w2')")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan


def test_norms_of_packs_of_any_size_equal_plain_ones(spark, monkeypatch):
    """Packs of a few terms or documents, sums given out early, ids of either type, texts without terms."""
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 50)))) for i in range(120)] + [(500, None), (501, "the"), (502, "")]
    counts = {i: slow_terms(t or "", set(retrieval.ENGLISH)) for i, t in docs}
    seen = Counter(t for c in counts.values() for t in c)
    want = {i: math.sqrt(sum(((1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + seen[t])) + 1)) ** 2 for t, n in c.items())) for i, c in counts.items() if c}
    given = spark.createDataFrame(docs, "id long, text string").repartition(3)
    for sizes in ((2 << 20, 1 << 16, 4 << 20), (60, 4, 10)):
        for name, size in zip(("PACK_TERMS", "PACK_DOCS", "HELD"), sizes):
            monkeypatch.setattr(packed, name, size)
        for id_ in ("id", "concat('x', id)"):
            got = {int(str(r.id).lstrip("x")): r.norm for r in retrieval.norms(given.selectExpr(f"{id_} as id", "text"), len(docs), retrieval.ENGLISH).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)
    assert retrieval.norms(given.where("false"), 0, []).count() == 0


def _moved(spark, df):
    """Bytes that the shuffles of a query write."""
    spark.sparkContext.setJobGroup("moved", "")
    df.write.format("noop").mode("overwrite").save()
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("moved") for s in tracker.getJobInfo(job).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s) is not None)


def test_a_term_moves_in_less_than_twelve_bytes(spark):
    """Rare terms are the worst case: each is in one document and can't share its hashes with another."""
    n = 100_000
    docs = spark.range(200, numPartitions=2).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n // 400)), lambda k: F.concat(F.lit("w"), F.xxhash64("id", k).cast("string"))), " ").alias("text"))
    assert _moved(spark, retrieval.norms(docs, 200, [])) < 12 * n


def test_postings_move_by_document_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one two{i % 7} three{i % 3}") for i in range(50)], "id long, text string")
    asked = spark.createDataFrame([(1, "one two3"), (2, "three1 two2")], "query long, text string")
    found = retrieval.search(retrieval.build(docs, str(tmp_path / "ix"), [], asked=asked), asked, 3, 0.01)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(id#", plan) and not re.search(r"hashpartitioning\(query#\w+, id#", plan)
    assert found.count() == 6
