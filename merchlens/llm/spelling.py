"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced code point turns into each other.

Two near words are equal before and behind the place of their edit. With positions 0 to m of the shorter word (m code
points) halved into windows, an edit falls into one window, so the words agree on the code points around it: these are
a bucket. Buckets of more than ``LIMIT`` words are divided by halving their window; a window of one position leaves at
most two code points free, so no bucket exceeds a constant. The middles of a bucket are sorted, and each is held against
those after it: rows of the banded edit matrix are kept up to the common prefix with the word before, and once a row
exceeds one edit, all words with that prefix are skipped. Rows have three cells of 0 to 2, packed into one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ragged
from .common import written

SHORTEST = 7
FEWEST = 2
DROP_ONE_IN = 31
TIMES = 10
LIMIT = 4096
ROWS = 1 << 16
CELLS = 1 << 22
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "a string, n_a long, b string, n_b long"


def _row_table() -> tuple[np.ndarray, np.ndarray]:
    """Next row of the banded matrix for a row (cells at one before, at, and one behind the diagonal, capped at 2) and
    the three equalities of its new code point; whether a row has a cell below 2."""
    step = np.zeros((27, 8), np.uint8)
    for row in range(27):
        before, on, behind = row // 9, row // 3 % 3, row % 3
        for equal in range(8):
            low = min(before + 1 - (equal & 1), on + 1, 2)
            mid = min(on + 1 - (equal >> 1 & 1), behind + 1, low + 1, 2)
            high = min(behind + 1 - (equal >> 2), mid + 1, 2)
            step[row, equal] = low * 9 + mid * 3 + high
    cells = np.arange(27)
    return step.ravel(), np.stack([cells // 9, cells // 3 % 3, cells % 3]).min(axis=0) < 2


STEP, ALIVE = _row_table()
CELL = np.array([[s // 9, s // 3 % 3, s % 3] for s in range(27)], np.uint8)
FIRST_ROW = 2 * 9 + 0 * 3 + 1


def scan(points: np.ndarray, begin: np.ndarray, size: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of words one edit apart within runs of words; ``opens`` marks the first word of each run, a run's
    words are distinct and sorted, and word i is ``points[begin[i] : begin[i] + size[i]]``."""
    n, width = len(size), int(size.max(initial=0))
    stride = width + 3
    cells = np.zeros((n, stride), points.dtype)
    cells.ravel()[np.repeat(np.arange(n) * stride + 1, size) + ragged(np.zeros(n, np.int64), size)] = points[ragged(begin, size)]
    same = (cells[1:, 1 : width + 1] == cells[:-1, 1 : width + 1]) & (cells[1:, 1 : width + 1] != 0)
    lcp = np.append(0, np.logical_and.accumulate(same, axis=1).sum(axis=1))
    lcp[opens] = -1
    place = np.arange(n)
    # behind[j, d]: the first word after j that does not share its first d code points
    behind = np.full((n + 1, width + 2), n)
    for d in range(1, width + 1):
        behind[:n, d] = np.where(lcp < d, place, n)
    behind = np.minimum.accumulate(behind[::-1], axis=0)[::-1]
    ends = np.append(np.flatnonzero(opens)[1:], n)[np.cumsum(opens) - 1]
    q = np.flatnonzero(place + 1 < ends)
    j, d = q + 1, np.zeros(len(q), np.int64)
    rows = np.full((n, width + 1), FIRST_ROW, np.uint8).ravel()
    cells, found = cells.ravel(), []
    while len(q):
        new = cells[j * stride + d + 1]
        at = q * stride + d
        equal = (cells[at] == new) + 2 * (cells[at + 1] == new) + 4 * (cells[at + 2] == new)
        row = STEP[rows[q * (width + 1) + d] * np.int64(8) + equal]
        d = d + 1
        rows[q * (width + 1) + d] = row
        alive = ALIVE[row]
        ended = d == size[j]
        last = np.flatnonzero(alive & ended)
        if len(last):
            off = size[q[last]] - size[j[last]]
            hit = last[(np.abs(off) < 2) & (CELL[row[last], np.clip(off + 1, 0, 2)] == 1)]
            found.append((q[hit], j[hit]))
        go_on = np.flatnonzero(~alive | ended)
        to = np.where(alive[go_on], j[go_on] + 1, behind[j[go_on] + 1, d[go_on]])
        j[go_on] = to
        out = to >= ends[q[go_on]]
        d[go_on] = lcp[np.where(out, 0, to)]
        if out.any():
            keep = np.ones(len(q), bool)
            keep[go_on[out]] = False
            q, j, d = q[keep], j[keep], d[keep]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _scan_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of whole buckets, with matrices of about ``CELLS`` cells."""
    rows = rows.combine_chunks()
    bucket, middle = (rows.column(c).combine_chunks() if rows.num_rows else rows.column(c) for c in ("bucket", "middle"))
    opens = np.append(True, pc.not_equal(bucket[1:], bucket[:-1]).to_numpy(zero_copy_only=False))
    starts = np.append(np.flatnonzero(opens), len(opens))
    size = pc.utf8_length(middle).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(middle.to_pylist()).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(size) - size
    short = rows.column("short").to_numpy()
    widest = np.maximum.reduceat(size, starts[:-1])
    count = np.diff(starts)
    order = np.argsort(widest, kind="stable")
    order = order[count[order] > 1]
    at = 0
    while at < len(order):
        cells = np.cumsum(count[order[at:]]) * (widest[order[at:]] + 4)
        some = np.sort(order[at : at + max(1, int(np.searchsorted(cells, CELLS, "right")))])
        at += len(some)
        index = ragged(starts[some], count[some])
        a, b = scan(points, begin[index], size[index], opens[index])
        a, b = index[a], index[b]
        mine = short[a] | short[b]  # both longer: found among words of their length
        pick = {name: rows.take(pa.array(i[mine])) for name, i in (("a", a), ("b", b))}
        yield from pa.table(
            {"a": pick["a"].column("word"), "n_a": pick["a"].column("n"), "b": pick["b"].column("word"), "n_b": pick["b"].column("n")}
        ).combine_chunks().to_batches()


def _scan_partition(batches):
    """Rows come sorted by bucket and middle; what may be an unfinished bucket waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < ROWS:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        bucket = rows.column("bucket").combine_chunks()
        cut = pc.index(pc.equal(bucket, bucket[-1]), True).as_py()
        if cut:
            yield from _scan_rows(rows.slice(0, cut))
        waiting = rows.slice(cut).to_batches()
    if waiting:
        yield from _scan_rows(pa.Table.from_batches(waiting))


def _bucketed(windows: DataFrame) -> DataFrame:
    """Rows (word, n, m, low, high) with the code points around positions low to high - 1, and those between."""
    tail = F.expr("greatest(m - high, 0)")
    around = F.concat_ws("|", "m", "low", "high", F.expr("left(word, low)"), F.expr("right(word, greatest(m - high, 0))"))
    middle = F.col("word").substr(F.col("low") + 1, F.char_length("word") - F.col("low") - tail)
    return windows.select("*", around.alias("bucket"), middle.alias("middle"), (F.char_length("word") == F.col("m")).alias("short"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), each pair once: the words of ``vocabulary`` (word, n; distinct) that one edit turns into each other."""
    size = F.char_length("word")
    both = F.explode(F.array(size, size - 1))
    halves = "inline(array(struct(0 AS low, (m + 1) div 2 AS high), struct((m + 1) div 2 AS low, m + 1 AS high)))"
    windows = vocabulary.select("word", "n", both.alias("m")).filter("m >= 0").selectExpr("word", "n", "m", halves).filter("low < high")
    found = []
    while True:
        rows = _bucketed(windows.withColumns({c: F.col(c).cast("int") for c in ("low", "high")}))
        large = rows.filter("high - low > 1").groupBy("bucket").count().filter(F.col("count") > LIMIT)
        large = written(large.select("bucket"), "spelling-large")
        ready = rows.join(large, "bucket", "left_anti").select("bucket", "middle", "short", "word", "n")
        ready = ready.repartition("bucket").sortWithinPartitions("bucket", "middle")
        found.append(written(ready.mapInArrow(_scan_partition, PAIRS), "spelling-pairs"))
        if large.isEmpty():
            break
        windows = rows.join(large, "bucket", "left_semi").selectExpr(
            "word", "n", "m", "inline(array(struct(low, (low + high) div 2 AS high), struct((low + high) div 2 AS low, high)))"
        )
        windows = written(windows, "spelling-windows")
    pairs = reduce(DataFrame.union, found)
    return pairs.selectExpr(
        "least(a, b) AS a", "IF(a < b, n_a, n_b) AS n_a", "greatest(a, b) AS b", "IF(a < b, n_b, n_a) AS n_b"
    ).distinct()  # an insertion into a run of equal code points has several places


def counted_words(documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): runs of letters, lower-cased in A-Z, each one of ``drop_one_in`` (by a checksum of id and run) without one
    code point; those of ``shortest`` code points at least that occur ``fewest`` times at least."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{shortest},}}"), F.lit(0))).alias("run")
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", runs)
    plain = F.octet_length("run") == F.char_length("run")  # only A-Z have lower case then
    runs = runs.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("CAST(h % char_length(run) AS INT)")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % drop_one_in == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. Each step of a chain has ``TIMES`` the occurrences of the one before,
    so chains are short; every round doubles what has been followed."""
    links = written(forms.filter("form IS NOT NULL").selectExpr("word", "form AS root"), "spelling-roots")
    while True:
        onward = links.selectExpr("word AS root", "root AS next")
        further = links.join(onward, "root", "left")
        if further.filter("next IS NOT NULL").isEmpty():
            return links
        links = written(further.selectExpr("word", "coalesce(next, root) AS root"), "spelling-roots")


def spelling_variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of ``vocabulary`` (word, n; words distinct and not null): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of most
    occurrences (of equals the first in code-point order) if it has ``times`` the occurrences of the word; the root is
    where following forms ends. Words of any length are compared; an empty vocabulary gives no rows.
    """
    vocabulary = written(vocabulary.select("word", F.col("n").cast("long").alias("n")), "spelling-vocabulary")
    pairs = written(near_words(vocabulary), "spelling-near")
    sides = pairs.selectExpr("a AS word", "b AS other", "n_b AS n_other").union(pairs.selectExpr("b", "a", "n_a"))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    forms = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best")
    )
    forms = forms.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    forms = written(forms, "spelling-forms")
    out = forms.join(_roots(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_variants(documents: DataFrame) -> DataFrame:
    """:func:`spelling_variants` of the words of whole documents (columns doc_id and text, others are not read).

    A null or empty text has no words, a null id counts as an empty one, repeated rows count again.
    """
    return spelling_variants(counted_words(documents))
