"""Secret scans: candidate strings in whole texts, and a random forest that removes false positives.

Candidates are private key blocks, web tokens, passwords in addresses, strings with a provider's
prefix, whole values assigned to words such as password or token, and runs of key characters.
The forest (Spark ML) sees their length, their character transitions against letter bigrams
counted over all documents, their coverage by words that are frequent in the documents, whether
they look like paths or mail, and the neighbouring words. It learns from labelled findings.
Where no labels are given, the clear ones are labelled by format (weak_labels): what is neither
clearly a secret nor clearly something else takes no part in training and is left to the forest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import common

AROUND = 48
# Words whose assignment speaks for a secret.
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "auth", "credential", "private_key", "passphrase"]
# Prefixes of providers' keys, and what follows them.
PROVIDERS = [
    "(?:AKIA|ASIA)[A-Z0-9]{16}", "gh[pousr]_[A-Za-z0-9]{36,}", "github_pat_[A-Za-z0-9_]{20,}", r"glpat-[\w\-]{20,}", "[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"sk-[\w\-]{20,}",
    r"xox[abeoprs]-[\w\-]{10,}", r"AIza[\w\-]{35}", r"SG\.[\w\-]{16,}\.[\w\-]{16,}", "npm_[A-Za-z0-9]{36}", "hf_[A-Za-z0-9]{30,}",
]
_MARKS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "k_live_", "k_test_", "sk-", "xox", "AIza", "SG.", "npm_", "hf_"]
_PROVIDER = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(PROVIDERS) + ")", re.ASCII)
# Header lines, then lines of key material (ends of lines may be written as \n) up to the END line; without it one long line at least.
_PEM = re.compile(
    r"-----BEGIN (?P<name>(?:[A-Z0-9]+ )*?PRIVATE KEY(?: BLOCK)?)-----(?:\s|\\[nr])*+(?:[A-Za-z][\w\-]*+: [^\n\\]*+(?:\s|\\[nr])++)*+"
    r"(?P<body>(?:[A-Za-z0-9+/=]|\s|\\[nr])++(?=-----END (?P=name)-----)|[A-Za-z0-9+/=]{40,}+(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{16,}+)*+)",
    re.ASCII,
)
_JWT = re.compile(r"eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,}", re.ASCII)
_URL = re.compile(r"://[^\s:/@\"']++:([^\s/@\"']{3,}+)@")
_ASSIGNED = re.compile(r"(?:" + "|".join(KEYWORDS) + r")[\w\-]{0,20}[\"']?\s{0,3}[:=]\s{0,3}(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;]{6,}))", re.IGNORECASE)
_BEARER = re.compile(r"bearer\s{1,3}([\w\-.=+/]{8,})", re.IGNORECASE | re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9_+/=\-]{16,}|(?<=[=:\"'\s])[A-Za-z0-9_+/=\-!@#$%^&*]{8,15}(?=[\"'\s]|$)")
_DIGIT, _UPPER, _LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
_RANDOM_CHARS = 20


@dataclass(frozen=True)
class Settings:
    """max_findings bounds the labelled findings that the forest learns from."""

    max_findings: int = 20_000
    trees: int = 24
    depth: int = 6
    seed: int = 7


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's candidates in order; where two overlap, the more specific kind stays."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if "-----BEGIN " in text:
        found += [(*m.span("body"), "key block") for m in _PEM.finditer(text)]
    if "eyJ" in text:
        found += [(*m.span(), "web token") for m in _JWT.finditer(text)]
    if "://" in text and "@" in text:
        found += [(*m.span(1), "address") for m in _URL.finditer(text)]
    if any(x in text for x in _MARKS):
        found += [(*m.span(), "provider") for m in _PROVIDER.finditer(text)]
    if any(x in low for x in KEYWORDS):
        found += [(*m.span(m.lastindex), "assigned") for m in _ASSIGNED.finditer(text)]
    if "bearer" in low:
        found += [(*m.span(1), "assigned") for m in _BEARER.finditer(text)]
    for m in _RUN.finditer(text):
        a, b = m.span()
        if _DIGIT.search(text, a, b) or b - a >= _RANDOM_CHARS and _UPPER.search(text, a, b) and _LOWER.search(text, a, b):
            found.append((a, b, "run"))
    kept: list[tuple[int, int, str]] = []
    if len({x[2] for x in found}) < 2:
        return found
    rank = {k: i for i, k in enumerate(("key block", "web token", "address", "provider", "assigned", "run"))}
    end_of: dict[int, int] = {}
    ordered = sorted(found, key=lambda x: (x[0], rank[x[2]], -x[1]))
    for a, b, kind in ordered:  # by start: an overlap is with the last one kept
        if kept and a < kept[-1][1]:
            if rank[kind] < rank[kept[-1][2]]:
                kept[-1] = (a, b, kind)
            continue
        kept.append((a, b, kind))
    return kept


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            out += [(key, a, kind, text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]) for a, b, kind in candidates(text)]
        columns = zip(*out) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "start", "kind", "value", "before", "after"])


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> candidates (doc_id, start, kind, value, before, after) from whole texts; start counts characters from 0."""
    return docs.select("doc_id", "text").mapInArrow(_find, "doc_id long, start long, kind string, value string, before string, after string")


# Letters a to z, a digit, anything else.
_CLASS = np.full(256, 27, np.int64)
_CLASS[48:58] = 26
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = _k


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(28 * 28, np.int64)
    for batch in batches:
        for _, _, raw, _ in common.text_blocks(batch.column(0)):
            c = _CLASS[raw]
            total += np.bincount(c[:-1] * 28 + c[1:], minlength=28 * 28)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


@dataclass(frozen=True)
class Language:
    """What the documents' own words look like."""

    bits: np.ndarray  # -log2 of the chance of a character class after another
    words: frozenset[str]


def language_of(docs: DataFrame, share: float = 5e-6, least: int = 3) -> Language:
    """Letter bigrams and frequent words, counted over all documents.

    A word of four or more letters is frequent if it is at least `share` of all such words (so
    there are 1 / share of them at most) and occurs `least` times.
    """
    pairs = docs.select("text").mapInArrow(_bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 784 at most
    n = np.ones(28 * 28)
    for r in pairs:
        n[r.pair] += r.n
    n = n.reshape(28, 28)
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(4, 20))
    counts = common.stored(words.groupBy("word").count().where(F.col("count") >= least), "secret-words")
    total = words_total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = counts.where(F.col("count") >= share * words_total).select("word").toArrow() if total else None
    return Language(-np.log2(n / n.sum(1, keepdims=True)), frozenset(frequent.column(0).to_pylist() if frequent is not None else ()))


def coverage(text: str, words: frozenset[str]) -> float:
    """The share of a string's characters that frequent words cover, the longest word first from left to right."""
    text, covered, i = text.lower(), 0, 0
    while i + 4 <= len(text):
        for k in range(min(20, len(text) - i), 3, -1):
            if text[i : i + k] in words:
                covered, i = covered + k, i + k
                break
        else:
            i += 1
    return covered / max(1, len(text))


_KEYWORD = "(?:" + "|".join(KEYWORDS) + "|bearer)"
_BEFORE = re.compile(_KEYWORD + r"[\w\-]{0,20}[\"']?\s{0,3}[:=]?\s{0,3}[\"']?$", re.IGNORECASE)
_NEAR = re.compile(_KEYWORD, re.IGNORECASE)
_PATH_BEFORE, _PATH_AFTER = re.compile(r"(?:://|[/\\.])\S*$"), re.compile(r"^[/\\]|^\.[a-z]{2,4}\b")
_MAIL_BEFORE, _MAIL_AFTER = re.compile(r"@\S*$"), re.compile(r"^@|^\.[0-9]+@")
_WORDS = re.compile("[a-z]{4,}")
FEATURES = ["length", "digits", "upper", "lower", "other", "distinct", "letter_digit", "case_changes", "repeats", "hex", "bits", "bits_most", "words", "path", "mail", "quoted", "assigned", "keyword", "near", "near_words"]


def _numbers(value: str, before: str, after: str, known: Language) -> list[float]:
    n = max(1, len(value))
    digits, upper, lower = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
    pairs = list(zip(value, value[1:]))
    c = _CLASS[np.frombuffer(value.encode("utf-8", "replace"), np.uint8)]
    bits = known.bits[c[:-1], c[1:]] if len(c) > 1 else np.zeros(1)
    around = _WORDS.findall((before + " " + after).lower())
    return [
        float(np.log2(n)), digits / n, upper / n, lower / n, 1 - (digits + upper + lower) / n, len(set(value)) / n,
        sum(a.isdigit() != b.isdigit() for a, b in pairs) / n, sum(a.islower() and b.isupper() or a.isupper() and b.islower() for a, b in pairs) / n, sum(a == b for a, b in pairs) / n,
        float(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) is not None), float(bits.mean()), float(np.sort(bits)[-(len(bits) // 4 + 1) :].mean()), coverage(value, known.words),
        float("/" in value[1:-1] or _PATH_BEFORE.search(before) is not None or _PATH_AFTER.search(after) is not None),
        float("@" in value and "." in value or _MAIL_BEFORE.search(before) is not None or _MAIL_AFTER.search(after) is not None),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"') and before != ""), float(re.search(r"[=:]\s{0,3}[\"']?$", before) is not None), float(_BEFORE.search(before) is not None),
        float(len(_NEAR.findall(before + " " + after))), sum(w in known.words for w in around) / max(1, len(around)),
    ]


def features(findings: DataFrame, known: Language) -> DataFrame:
    """findings with an array column `numbers`, in the order of FEATURES."""
    shared, names = findings.sparkSession.sparkContext.broadcast(known), findings.columns  # its words are bounded by their share
    at = [names.index(x) for x in ("value", "before", "after")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_numbers(v or "", b or "", a or "", shared.value) for v, b, a in zip(*(batch.column(i).to_pylist() for i in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*names, "numbers"])

    return findings.mapInArrow(run, StructType([*findings.schema.fields, StructField("numbers", ArrayType(DoubleType()))]))


def weak_labels(findings: DataFrame) -> DataFrame:
    """Labels the clear findings: 1 for secrets by format, 0 for placeholders and things that look alike, null for the rest.

    1: providers' formats, web tokens, key blocks, passwords in addresses, and values assigned
    to a keyword that have letters, digits and many different characters. 0: placeholders,
    references to variables, numbers (phones, cards, dates), mail, paths and files, digests by
    name, and strings of letters in one case outside assignments.
    """
    value, kind = F.col("value"), F.col("kind")
    has = lambda pattern: value.rlike(pattern)
    provider = has("^(?:" + "|".join(p.replace(r"\w", "[A-Za-z0-9_]") for p in (x.replace(r"[\w\-]", r"[A-Za-z0-9_\-]") for x in PROVIDERS)) + ")$")
    varied = (F.length(value) >= 8) & (F.size(F.array_distinct(F.split(value, ""))) >= 7) & has("[0-9]") & has("[A-Za-z]")
    placeholder = F.lower(value).rlike(r"example|changeme|change_me|your|placeholder|dummy|xxxx|1234567|(.)\1{5}|^<.*>$|\*{3}") & (kind != "key block")
    variable = has(r"^[$%]|\$\{|^[A-Za-z_]+\(|process\.env|os\.environ") & (kind != "key block")
    number = has(r"^[+]?[0-9][0-9()/.,:\-+]*$")
    mail = F.col("before").rlike(r"@\S*$") | F.col("after").rlike("^@") | has(r"^[^@\s]+@[^@\s]+\.[a-z]+$")
    path = F.col("before").rlike(r"(?:://|[/\\])\S*$") | F.col("after").rlike(r"^[/\\]|^\.[a-z]{2,4}\b") | has(r"^/|\.[a-z]{2,4}$|://")
    digest = F.lower("before").rlike(r"(?:sha-?[0-9]+|md5|commit|checksum|digest|etag|revision|uuid)\W{0,3}$")
    letters = (kind == "run") & has("^[a-z_\\-]+$|^[A-Z_\\-]+$")
    sure = provider | kind.isin("key block", "web token") | ((kind == "address") & (F.length(value) >= 6)) | ((kind == "assigned") & varied & ~value.contains(" "))
    never = placeholder | variable | number | ((kind == "run") & (mail | path | digest | letters))
    return findings.withColumn("label", F.when(never, 0).when(sure, 1))


def train(labelled: DataFrame, known: Language, settings: Settings = Settings()):
    """Labelled findings (value, before, after, label) -> a forest, or None unless both labels occur.

    At most settings.max_findings distinct findings are used, half of each label, chosen by a hash; null labels are left out.
    """
    distinct = labelled.where("label in (0, 1) and value is not null").groupBy("value", "before", "after").agg(F.max("label").cast("double").alias("label"))
    order = F.xxhash64(F.lit(settings.seed), "value", "before", "after")
    parts = [distinct.where(F.col("label") == y).orderBy(order, "value", "before", "after").limit(settings.max_findings // 2) for y in (0, 1)]
    sample = common.stored(features(parts[0].union(parts[1]), known).select(array_to_vector("numbers").alias("features"), "label"), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, maxBins=32).fit(sample)


def classify(findings: DataFrame, known: Language, model) -> DataFrame:
    """findings -> with score (0 to 1) and is_secret (a score of exactly 0.5 counts). Without a model the score is null and nothing is removed."""
    if model is None:
        return findings.withColumns({"score": F.lit(None).cast("double"), "is_secret": F.lit(True)})
    scored = model.transform(features(findings, known).withColumn("features", array_to_vector("numbers")))
    score = vector_to_array("probability")[1]
    return scored.withColumns({"score": score, "is_secret": score >= 0.5}).select(*findings.columns, "score", "is_secret")


def held_out(doc_id: Column) -> Column:
    """The fold that weak labels are never learned from: crc32(doc_id as text) mod 5 is 0, or no id."""
    return F.coalesce(common.shard_of(doc_id, 5) == 0, F.lit(True))


def scan(docs: DataFrame, labelled: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """documents -> findings (doc_id, start, kind, value, before, after, score, is_secret), a row for each candidate.

    labelled has findings (value, before, after) with a label; without it clear findings of docs outside the held-out fold are
    labelled by format. Texts are scanned whole, however long. Null and empty texts have no
    findings; an empty table gives none; repeated rows keep theirs; a null doc_id stays null;
    other columns are ignored.
    """
    findings = common.stored(find(docs), "secret-findings")
    known = language_of(docs)
    if labelled is None:
        labelled = weak_labels(findings.where(~held_out(F.col("doc_id"))))
    return classify(findings, known, train(labelled, known, settings))


def held_out_figures(scanned: DataFrame) -> DataFrame:
    """scan()'s rows -> precision and recall on the clearly labelled findings of the held-out fold."""
    told = weak_labels(scanned.where(held_out(F.col("doc_id")))).where("label is not null")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit, kept, true = count(F.col("is_secret") & (F.col("label") == 1)), count(F.col("is_secret")), count(F.col("label") == 1)
    return told.agg(F.count("*").alias("findings"), true.alias("secrets"), (hit / kept).alias("precision"), (hit / true).alias("recall"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding that is kept, without the secret itself: a digest stands for it."""
    kept = scan(common.table(spark, sf_dir, "documents")).where("is_secret")
    return kept.select("doc_id", "start", "kind", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE_SQL: dict[str, str] = {}
