"""Secret scan: candidate strings, a random forest on their shape and surroundings, redaction.

Candidates are long runs of key characters. Their features are length, character make-up and transitions, coverage by
the corpus' own letter sequences, words in the path and words around them. A random forest trained on labelled
findings removes false positives; it is evaluated inside the scan, so texts are read where they lie and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks
from .common import written

#: Labelled findings the forest is fitted on, for each of the two labels.
FIT_FINDINGS = 10_000
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
MASK = b"[SECRET]"
MIN_LENGTH = 12
MIN_WORDLIKE = 16
AROUND = 40

KEY_BYTES = np.zeros(256, bool)
KEY_BYTES[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, np.int64)
LETTER[97:123] = np.arange(1, 27)
LETTER[65:91] = np.arange(1, 27)
GRAM = 4
GRAM_SLOTS = 27**GRAM

#: Words that speak for and against a secret, near it or in the path.
ASSIGNED = re.compile(rb"(token|secret|passw(or)?d|passwd|pwd|api_?-?key|access_?-?key|auth|credential|private_?-?key|bearer)[\"']?\s*[=:]\s*[\"']?$", re.I)
FOR_WORDS = re.compile(rb"token|secret|passw|pwd|key|auth|credential|bearer|login", re.I)
AGAINST_WORDS = re.compile(rb"(?<![.@\w])(?:sha\d|hash|md5|commit|uuid|checksum|digest|card|phone|isbn|order|invoice|example|sample|dummy)", re.I)
PATH_WORDS = re.compile(r"test|example|sample|fixture|mock|doc|vendor|lock", re.I)
#: Formats that are secrets wherever they stand.
FORMATS = {
    "aws_key_id": re.compile(rb"(AKIA|ASIA)[0-9A-Z]{16}"),
    "github_token": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}"),
    "slack_token": re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "stripe_key": re.compile(rb"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
}
NAMES = (
    "length", "digits", "upper", "lower", "symbols", "hex_only", "entropy", "class_changes", "transition", "coverage",
    "assigned", "words_for", "words_against", "quoted", "equals_before", "path_words", "known_format", "only_digits",
)


@dataclass
class Corpus:
    """Letter statistics of the whole corpus: log probabilities of letter pairs, and frequent letter sequences."""

    pair: np.ndarray
    common: np.ndarray


def letter_statistics(texts: DataFrame) -> Corpus:
    """Counts over every text of the first column; sequences count as known from 1 in a million letters on."""
    column = texts.columns[0]

    def count(batches):
        pairs, grams, n = np.zeros(27 * 27, np.int64), np.zeros(GRAM_SLOTS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(column)):
                letter = LETTER[data]
                letter[offsets[:-1][offsets[:-1] < len(data)]] = 0  # sequences do not cross texts
                if len(letter) < GRAM:
                    continue
                pairs += np.bincount(letter[:-1] * 27 + letter[1:], minlength=27 * 27)
                code = ((letter[:-3] * 27 + letter[1:-2]) * 27 + letter[2:-1]) * 27 + letter[3:]
                inside = (letter[:-3] > 0) & (letter[1:-2] > 0) & (letter[2:-1] > 0) & (letter[3:] > 0)
                grams += np.bincount(code[inside], minlength=GRAM_SLOTS)
                n += int((letter > 0).sum())
        at = np.flatnonzero(grams)
        slots = np.concatenate([at, GRAM_SLOTS + np.arange(27 * 27), [GRAM_SLOTS + 27 * 27]])
        yield pa.RecordBatch.from_pydict({"slot": slots.astype(np.int32), "n": np.concatenate([grams[at], pairs, [n]])})

    found = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(GRAM_SLOTS + 27 * 27 + 1, np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    pair = total[GRAM_SLOTS:-1].reshape(27, 27) + 1.0
    pair = np.log(pair / pair.sum(1, keepdims=True))
    return Corpus(pair, total[:GRAM_SLOTS] > total[-1] / 1_000_000)


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the key-like runs of a block: 12 bytes with a digit, or 16 of any key characters."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    key = KEY_BYTES[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    joined = key[1:] & key[:-1] & ~edge[1:n]
    opens, closes = key.copy(), key.copy()
    opens[1:] &= ~joined
    closes[:-1] &= ~joined
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - start >= MIN_LENGTH
    start, end = start[long], end[long]
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    keep = (digits[end] > digits[start]) | (end - start >= MIN_WORDLIKE)
    start, end = start[keep], end[keep]
    return np.searchsorted(offsets, start, "right") - 1, start, end


def known_format(value: bytes) -> str | None:
    return next((name for name, pattern in FORMATS.items() if pattern.fullmatch(value)), None)


def describe(value: bytes, before: bytes, after: bytes, path: str, corpus: Corpus) -> list[float]:
    """Features of a candidate, in the order of ``NAMES``."""
    n = len(value)
    digits = sum(48 <= b < 58 for b in value)
    upper = sum(65 <= b < 91 for b in value)
    lower = sum(97 <= b < 123 for b in value)
    kinds = [1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123 else 4 for b in value]
    letters = LETTER[np.frombuffer(value, np.uint8)]
    code = ((letters[:-3] * 27 + letters[1:-2]) * 27 + letters[2:-1]) * 27 + letters[3:]
    known = corpus.common[code] & (letters[:-3] > 0) & (letters[1:-2] > 0) & (letters[2:-1] > 0) & (letters[3:] > 0)
    covered = np.zeros(n, bool)
    for j in range(GRAM):
        covered[j : n - GRAM + 1 + j] |= known
    return [
        min(n, 512), digits / n, upper / n, lower / n, (n - digits - upper - lower) / n,
        float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None),
        -sum(c / n * math.log2(c / n) for c in Counter(value).values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1),
        float(corpus.pair[letters[:-1], letters[1:]].mean()), float(covered.mean()),
        float(ASSIGNED.search(before) is not None), float(len(FOR_WORDS.findall(before))), float(len(AGAINST_WORDS.findall(before + b" " + after))),
        float(before[-1:] in (b'"', b"'")), float(before.rstrip(b" \"'")[-1:] in (b"=", b":")),
        float(PATH_WORDS.search(path) is not None), float(known_format(value) is not None), float(digits == n),
    ]


def rule_label(value: bytes, before: bytes, after: bytes) -> int | None:
    """Label of a finding that speaks for itself, else None.

    1: a known format, or an assignment to a secret's name of a value with digits. 0: digits only, words without digits,
    or words against it nearby.
    """
    digits = sum(48 <= b < 58 for b in value)
    if known_format(value):
        return 1
    if digits == len(value) or digits == 0 or AGAINST_WORDS.search(before + b" " + after):
        return 0
    return 1 if ASSIGNED.search(before) else None


def _around(data: bytes, low: int, high: int, start: int, end: int) -> tuple[bytes, bytes, bytes]:
    return data[start:end], data[max(low, start - AROUND) : start], data[end : min(high, end + AROUND)]


def label_findings(documents: DataFrame, corpus: Corpus, path: str = "source") -> DataFrame:
    """Labelled findings (features, label) of documents by :func:`rule_label`.

    Each is there twice, the second time without what stands around it, so that a forest also learns from the string.
    """
    blank = [NAMES.index(x) for x in ("assigned", "words_for", "words_against", "quoted", "equals_before", "known_format", "path_words")]

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            features, labels = [], []
            for at, _, data, offsets in blocks(batch.column("text")):
                raw = data.tobytes()
                for row, start, end in zip(*(x.tolist() for x in candidates(data, offsets)), strict=True):
                    value, before, after = _around(raw, offsets[row], offsets[row + 1], start, end)
                    label = rule_label(value, before, after)
                    if label is not None:
                        full = describe(value, before, after, paths[at + row] or "", corpus)
                        bare = [0.0 if i in blank else x for i, x in enumerate(full)]
                        features += [full, bare]
                        labels += [label, label]
            yield pa.RecordBatch.from_pydict({"features": pa.array(features, pa.list_(pa.float64())), "label": pa.array(labels, pa.float64())})

    return documents.select("text", _path(documents, path)).mapInArrow(run, "features array<double>, label double")


def _path(documents: DataFrame, path: str) -> Column:
    """The column that says where a text comes from, null if there is none, as ``path``."""
    return (F.col(path).cast("string") if path in documents.columns else F.lit(None).cast("string")).alias("path")


@dataclass
class Forest:
    """Trees as flat arrays (feature, threshold, left, right; leaves have feature -1 and their vote as threshold)."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of trees that vote for a secret."""
        votes = np.zeros(len(x))
        for feature, threshold, left, right in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
            votes += threshold[node]
        return votes / max(1, len(self.trees))


def read_trees(text: str) -> Forest:
    """Forest from Spark's description of it."""
    trees, nodes, depth = [], None, []
    for line in text.splitlines():
        word = line.strip()
        if word.startswith("Tree "):
            nodes, depth = [], []
            trees.append(nodes)
        elif word.startswith("If "):
            feature, bound = re.search(r"feature (\d+) <= ([-\d.E]+)", word).groups()
            _hang(nodes, depth, [int(feature), float(bound), -1, -1])
            depth.append(len(nodes) - 1)
        elif word.startswith("Predict"):
            _hang(nodes, depth, [-1, float(word.split()[1]), -1, -1])
    return Forest([tuple(np.array(c) for c in zip(*t, strict=True)) for t in trees])


def _hang(nodes: list, depth: list, node: list) -> None:
    """Adds a node to the tree as the next free child of the innermost open parent."""
    nodes.append(node)
    if depth:
        parent = nodes[depth[-1]]
        side = 2 if parent[2] < 0 else 3
        parent[side] = len(nodes) - 1
        if side == 3:
            depth.pop()


def fit_forest(findings: DataFrame, seed: int = 7) -> Forest | None:
    """Random forest from labelled findings (features, label); about ``FIT_FINDINGS`` of each label, those with the
    smallest hash, and of equal ones no more than their share. None unless both labels occur."""
    sizes = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if not (sizes.get(0.0) and sizes.get(1.0)):
        return None
    share = F.when(F.col("label") == 1, min(1.0, FIT_FINDINGS / sizes[1.0])).otherwise(min(1.0, FIT_FINDINGS / sizes[0.0]))
    drawn = findings.filter(F.xxhash64("features", "label") / F.lit(2.0**64) + 0.5 <= share)
    drawn = drawn.groupBy("features", "label").agg(F.count("*").alias("n")).withColumn("n", F.ceil(F.col("n") * share).cast("int"))
    drawn = drawn.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).select(array_to_vector("features").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    return read_trees(forest.fit(drawn).toDebugString)


@dataclass
class Scanner:
    """What a scan needs: letter statistics and the forest (without one, findings are judged by rule)."""

    corpus: Corpus
    forest: Forest | None

    def judge(self, rows) -> tuple[np.ndarray, list[str]]:
        """Scores and kinds of findings (value, before, after, path)."""
        if not rows:
            return np.empty(0), []
        if self.forest is None:
            score = np.array([float(rule_label(v, b, a) or 0) for v, b, a, _ in rows])
        else:
            score = self.forest.score(np.array([describe(v, b, a, p, self.corpus) for v, b, a, p in rows]))
        kinds = [known_format(v) or ("assigned" if ASSIGNED.search(b) else "string") for v, b, _, _ in rows]
        return score, kinds


def fit(documents: DataFrame, path: str = "source", findings: DataFrame | None = None) -> Scanner:
    """Scanner from the corpus; ``findings`` (features, label) may come from reviewers, else rules label them."""
    corpus = letter_statistics(documents.select(F.col("text").cast("string").alias("text")))
    if findings is None:
        findings = written(label_findings(documents, corpus, path), "secret-findings")
    return Scanner(corpus, fit_forest(findings))


def _findings(batch, scanner: Scanner, text: str = "text"):
    """(block's first row, bytes, offsets, rows, starts, ends, scores, kinds) of a batch."""
    paths = batch.column("path").to_pylist()
    for at, to, data, offsets in blocks(batch.column(text)):
        raw = data.tobytes()
        row, start, end = (x.tolist() for x in candidates(data, offsets))
        rows = [(*_around(raw, offsets[r], offsets[r + 1], s, e), paths[at + r] or "") for r, s, e in zip(row, start, end, strict=True)]
        score, kinds = scanner.judge(rows)
        yield at, to, raw, offsets, row, start, end, score, kinds


def scan(documents: DataFrame, scanner: Scanner, path: str = "source") -> DataFrame:
    """One row per finding: doc_id, start and length in UTF-8 bytes, kind, score, is_secret, and the string's SHA-256.

    Null and empty texts have no findings; a null path says nothing; repeated rows are reported each; texts are read
    whole, and an empty table gives no rows. Columns other than doc_id, text and ``path`` are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scanner)
    schema = "doc_id long, start long, length long, kind string, score double, is_secret boolean, value binary"

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, _, raw, offsets, row, start, end, score, kinds in _findings(batch, shared.value):
                if row:
                    rows = np.array(row)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": ids.take(pa.array(rows + at)),
                            "start": pa.array(np.array(start) - offsets[rows]),
                            "length": pa.array(np.array(end) - np.array(start)),
                            "kind": pa.array(kinds),
                            "score": pa.array(score),
                            "is_secret": pa.array(score >= THRESHOLD),
                            "value": pa.array([raw[s:e] for s, e in zip(start, end, strict=True)], pa.binary()),
                        }
                    )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _path(documents, path)).mapInArrow(run, schema)
    return rows.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def redact(documents: DataFrame, scanner: Scanner, path: str = "source") -> DataFrame:
    """``documents`` with ``[SECRET]`` in the place of each string judged to be a secret; all rows and columns stay.

    Null texts stay null, empty ones empty; texts are read whole, repeated rows are masked each, an empty table stays
    empty, and columns may have any names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scanner)
    columns, schema = documents.columns, T.StructType(documents.schema.fields)

    def run(batches):
        for batch in batches:
            for at, to, raw, offsets, row, start, end, score, _ in _findings(batch, shared.value, "in_text"):
                spans: dict[int, list[tuple[int, int]]] = {}
                for r, s, e, p in zip(row, start, end, score, strict=True):
                    if p >= THRESHOLD:
                        spans.setdefault(r, []).append((s, e))
                part = batch.slice(at, to - at)
                if spans:
                    texts = part.column("in_text").to_pylist()
                    for r, found in spans.items():
                        pieces, last = [], int(offsets[r])
                        for s, e in found:
                            pieces += [raw[last:s], MASK]
                            last = e
                        texts[r] = b"".join([*pieces, raw[last : offsets[r + 1]]]).decode()
                    part = part.set_column(part.schema.get_field_index("in_text"), "in_text", pa.array(texts, pa.string()))
                yield part.select([f"in_{c}" for c in columns]).rename_columns(columns)

    renamed = documents.select(*[F.col(c).alias(f"in_{c}") for c in columns], _path(documents, path))
    return renamed.mapInArrow(run, schema)


def find_secrets(documents: DataFrame) -> DataFrame:
    """Fit on the documents and scan them."""
    return scan(documents, fit(documents))
