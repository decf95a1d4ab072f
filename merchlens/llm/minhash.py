"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A text is its five-word shingles, weighted by frequency and inverse document frequency. Improved consistent weighted
sampling gives ``BANDS * ROWS`` samples that two texts share with the probability of their weighted Jaccard
similarity; bands of samples bring candidates together, and each candidate pair is verified on the whole texts.
Texts with equal shingles are one node throughout.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER_WORDS, U64, blocks, mix, ragged, shingles, signed, split_words, text_arrays
from .common import among, components, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 3
#: Weights fall with the share of the documents from this share on. Rarer shingles weigh the same: else what the copies of a
#: group share weighs less than their edits, by more the larger the group and the table are, and near copies part.
HEAVY = 0.01
#: Shingles whose frequencies are counted together, bytes of text whose shingles travel together, shingles sampled at once.
SLOT_SHINGLES = 1 << 21
GROUP_BYTES = 1 << 22
SAMPLED = 1 << 16
#: Bits a document of the map of the ids whose texts are compared: it passes up to an eighth of the others too.
HASH_BITS = 8
#: Buckets up to this size compare all their members; larger ones are split by a second band and compared with leaders.
SMALL = 32
#: Scramblings that pick a leader of a large bucket, besides its smallest member, and the leader of its parts.
LEADERS = (0x2545F491, 0x5DEECE66D)
#: Texts, and bytes of text, of a segment of a large bucket whose members the leaders did not all link.
SEGMENT = 128
SEGMENT_BYTES = 1 << 20

_LOW48 = U64((1 << 48) - 1)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 48-bit shingle key, frequency) of a block, sorted by row and key."""
    row, key = shingles(split_words(data, offsets, LOWER_WORDS), SHINGLE)
    both = np.sort((row.astype(U64) << U64(48)) | (key >> U64(16)))
    if not len(both):
        return np.empty(0, np.int64), both, np.empty(0, np.int64)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return (both[at] >> U64(48)).astype(np.int64), both[at] & _LOW48, np.diff(np.append(at, len(both)))


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of shingles in ``df`` of ``n`` documents, at most that of a share of ``HEAVY``."""
    return np.minimum(1 + np.log10(max(1, n) / np.maximum(1, df)), 1 + np.log10(1 / HEAVY))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each that hold the largest."""
    return x.astype(np.min_scalar_type(x.max(initial=0))).tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{len(packed) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    """``_packed`` numbers under an entropy code, after a byte with their width."""
    packed = _packed(x)
    return bytes([len(packed) // max(1, len(x))]) + pa.compress(packed, codec="zstd", asbytes=True)


def _expanded(squeezed: bytes, n: int) -> np.ndarray:
    return _unpacked(pa.decompress(squeezed[1:], squeezed[0] * n, codec="zstd", asbytes=True), n)


def _low_bytes(key: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_low_bytes(data: np.ndarray, width: int) -> np.ndarray:
    wide = np.zeros((len(data) // width, 8), np.uint8)
    wide[:, :width] = data.reshape(-1, width)
    return wide.view("<u8").ravel().astype(U64)


CELL = "group long, slot long, keys binary, steps binary, tf binary"


def shingle_cells(documents: DataFrame, bits: int) -> DataFrame:
    """The shingles of groups of rows, cut by the first ``bits`` bits of their keys.

    A cell holds the other bits of its keys, ordered by row and key, the squeezed steps from row to row and the frequencies.
    A group has one more row, in a slot of its own below 0: ids, which of them are null, and keys of the whole texts.
    """
    rest = U64(48 - bits)
    width = (48 - bits + 7) // 8

    def cells(group, ids, texts, parts):
        slots, keys, steps, tfs = [-1 - group], [ids.fill_null(0).to_numpy().tobytes()], [_packed(ids.is_null().to_numpy(False))], []
        tfs.append(texts.to_numpy().tobytes())
        row, key, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        slot = (key >> rest).astype(np.uint16)
        order = np.argsort(slot, kind="stable")
        slot, row, key, tf = slot[order], row[order], key[order] & ((U64(1) << rest) - U64(1)), tf[order]
        begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
        for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(slot)], strict=False):
            slots.append(int(slot[low]))
            keys.append(_low_bytes(key[low:high], width))
            steps.append(_squeezed(np.diff(row[low:high], prepend=0)))
            tfs.append(_packed(tf[low:high]))
        return pa.RecordBatch.from_arrays(
            [pa.array([group] * len(slots), pa.int64()), pa.array(slots, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, steps, tfs))],
            names=["group", "slot", "keys", "steps", "tf"],
        )

    def run(batches):
        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            begin, size, parts = 0, 0, []
            for low, high, data, offsets in blocks(batch.column("text")):
                row, key, tf = weighted_shingles(data, offsets)
                parts.append((row + (low - begin), key, tf))
                size += len(data)
                if size >= GROUP_BYTES or high == batch.num_rows:
                    yield cells(group, batch.column("doc_id")[begin:high], batch.column("text_key")[begin:high], parts)
                    group, begin, size, parts = group + 1, high, 0, []

    return documents.selectExpr("doc_id", "text", TEXT_KEY).mapInArrow(run, CELL)


def with_frequencies(cells: DataFrame, bits: int) -> DataFrame:
    """Cells with the document frequency of each of their shingles. All cells of a slot meet, so counts are exact; a slot
    has about ``SLOT_SHINGLES`` shingles, and those in most documents add a few bytes a document to one of them."""
    width = (48 - bits + 7) // 8

    def run(slot: pa.Table) -> pa.Table:
        if slot.column("slot")[0].as_py() < 0:
            return slot.append_column("df", pa.nulls(len(slot), pa.binary()))
        data, offsets = text_arrays(slot.column("keys"))
        key = _from_low_bytes(data[offsets[0] : offsets[-1]], width)
        distinct, df = np.empty(0, U64), np.empty(0, np.int64)
        for part in np.array_split(key, -(-len(key) // SLOT_SHINGLES)):
            more, count = np.unique(part, return_counts=True)
            distinct, at = np.unique(np.concatenate([distinct, more]), return_inverse=True)
            df = np.bincount(at, np.concatenate([df, count]), len(distinct)).astype(np.int64)
        ends = (offsets - offsets[0]) // width
        found = [_packed(df[np.searchsorted(distinct, key[i:j])]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return slot.append_column("df", pa.array(found, pa.binary()))

    return cells.groupBy("slot").applyInArrow(run, f"{CELL}, df binary")


@cache
def _gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution in 65,536 cells: value, 1 / value and logarithm."""
    grid = np.concatenate([np.geomspace(1e-5, 1, 200_000), np.linspace(1, 30, 400_000)[1:]])
    share = 1 - (1 + grid) * np.exp(-grid)
    share[grid < 1e-2] = grid[grid < 1e-2] ** 2 / 2
    value = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), share, grid)
    return value.astype(np.float32), (1 / value).astype(np.float32), np.log(value).astype(np.float32)


def samples(row: np.ndarray, key: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
    """(samples x n_rows) keys of the consistent weighted samples; rows must be sorted, each with a shingle or more."""
    gamma, inverse, log_gamma = _gamma_tables()
    low16 = U64(0xFFFF)
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    rank = np.cumsum(np.append(True, row[1:] != row[:-1])) - 1
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((BANDS * ROWS, n_rows), U64)
    for k in range(len(out)):
        z = mix(key + U64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = (z & low16).astype(np.int64)
        beta = ((z >> U64(16)) & low16).astype(np.float32) / np.float32(1 << 16)
        t = np.floor(log_w * inverse[r] + beta)
        log_a = log_gamma[((z >> U64(32)) & low16).astype(np.int64)] - gamma[r] * (t - beta + 1)
        least = np.minimum.reduceat(log_a, begins)
        hit = np.flatnonzero(log_a == least[rank])
        first = np.flatnonzero(np.append(True, rank[hit[1:]] != rank[hit[:-1]]))
        at = hit[first]
        out[k] = mix(key[at] ^ mix(t[at].astype(np.int64).view(U64) + U64(k)))
    return out


SIGNATURE = "doc_id long, text_key long, bag1 long, bag2 long, bands array<long>, df binary"
TEXT_KEY = "xxhash64(text) AS text_key"


def signatures(documents: DataFrame) -> DataFrame:
    """Per document: two keys of its weighted shingles, its band keys and the document frequencies of its shingles by
    key; all null for a text without words."""
    size, full = documents.agg(F.sum(F.octet_length("text")), F.count_if(F.col("text").rlike(r"[^\x20\x09-\x0D]"))).first()
    # a shingle has some six bytes; two bytes hold a slot
    bits = min(16, max(8, int((size or 0) // (6 * SLOT_SHINGLES)).bit_length()))
    return group_signatures(with_frequencies(shingle_cells(documents, bits), bits), bits, full)


def group_signatures(cells: DataFrame, bits: int, n_documents: int) -> DataFrame:
    rest = U64(48 - bits)
    width = (48 - bits + 7) // 8

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("slot")
        ids, nulls, text_key = (group.column(c)[0].as_py() for c in ("keys", "steps", "tf"))
        n = len(ids) // 8
        row, key, tf, df = [np.empty(0, np.int64)], [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for cell in group.slice(1).to_pylist():
            low = _from_low_bytes(np.frombuffer(cell["keys"], np.uint8), width)
            key.append(low | U64(cell["slot"]) << rest)
            row.append(np.cumsum(_expanded(cell["steps"], len(low))))
            tf.append(_unpacked(cell["tf"], len(low)))
            df.append(_unpacked(cell["df"], len(low)))
        row, key, tf, df = (np.concatenate(x) for x in (row, key, tf, df))
        order = np.argsort(row, kind="stable")
        row, key, tf, df = row[order], key[order], tf[order], df[order]
        first = np.searchsorted(row, np.arange(n + 1))
        bags = np.zeros((2, n), np.int64)
        bands = []
        at = 0
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(first, first[at] + SAMPLED, "right")) - 1))
            part = slice(first[at], first[to])
            if first[at] < first[to]:
                full = np.unique(row[part])
                begins = np.searchsorted(row[part], full)
                for i in (0, 1):
                    term = mix(mix(key[part] + U64(i * 0x632BE59BD9B4E019)) + tf[part].astype(U64) * U64(0x9FB21C651E98DF25))
                    bags[i, full] = signed(mix(np.add.reduceat(term, begins)))
                taken = samples(row[part], key[part], tf[part] * idf(df[part], n_documents), len(full))
                grouped = taken.reshape(BANDS, ROWS, -1)
                band = np.arange(BANDS, dtype=U64)[:, None] * U64(0xD1B54A32D192ED03)
                for i in range(ROWS):
                    band = mix(band * U64(0xA0761D6478BD642F) + grouped[:, i])
                bands.append(signed(np.ascontiguousarray(band.T)).ravel())
            at = to
        none = first[1:] == first[:-1]
        ends = np.concatenate([[0], np.cumsum(~none * BANDS)])
        frequencies = [None if i == j else _packed(df[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
        return pa.Table.from_arrays(
            [
                pa.array(np.frombuffer(ids, np.int64), mask=_unpacked(nulls, n).astype(bool)),
                pa.array(np.frombuffer(text_key, np.int64)),
                pa.array(bags[0], mask=none),
                pa.array(bags[1], mask=none),
                pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *bands])), mask=pa.array(none)
                ),
                pa.array(frequencies, pa.binary()),
            ],
            names=["doc_id", "text_key", "bag1", "bag2", "bands", "df"],
        )

    return cells.groupBy("group").applyInArrow(run, SIGNATURE)


def _bucket_pairs(placed: DataFrame, scramble: int, smallest: bool) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs, rows of large buckets) of bucket members (key, rep, band, bands)."""
    mask = F.lit(scramble)
    sizes = placed.groupBy("key").agg(
        F.count("*").alias("m"), F.min("rep").alias("l0"), F.min(F.col("rep").bitwiseXOR(mask)).bitwiseXOR(mask).alias("l1")
    )
    members = placed.join(sizes.filter("m > 1"), "key")
    small = members.filter(F.col("m") <= SMALL).select("key", "rep")
    pairs = small.selectExpr("key", "rep AS a").join(small.selectExpr("key", "rep AS b"), "key").filter("a < b").select("a", "b")
    large = members.filter(F.col("m") > SMALL)
    for leader in ("l0", "l1") if smallest else ("l1",):
        led = large.filter(F.col(leader) != F.col("rep"))
        pairs = pairs.union(led.select(F.least(leader, "rep").alias("a"), F.greatest(leader, "rep").alias("b")))
    return pairs, large.select("key", "rep", "band", "bands")


def candidate_pairs(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first pairs (a, b), a < b, of nodes (rep, bands) that share a band; members (key, rep) of large buckets).

    Small buckets give all their pairs. A large bucket gives the pairs of each member with two leaders, and is split
    by every further band: similar members share several bands, dissimilar ones part. A part that is large again gives
    the pairs with one leader. Leaders are the members of least scrambled id, so buckets of one group mostly agree.
    What these pairs leave unlinked in a large bucket is compared by :func:`unlinked_links`.
    """
    placed = reps.select("rep", "bands", F.posexplode("bands").alias("band", "key")).select("key", "rep", "band", "bands")
    pairs, large = _bucket_pairs(written(placed, "minhash-bands"), LEADERS[0], True)
    rest = F.slice("bands", F.col("band") + 2, BANDS)
    deeper = large.select("key", "rep", "band", "bands", F.explode(rest).alias("second"))
    deeper = deeper.select(F.xxhash64("key", "second").alias("key"), "rep", "band", "bands")
    more, _ = _bucket_pairs(written(deeper, "minhash-split"), LEADERS[1], False)
    return written(pairs.union(more).distinct(), "minhash-pairs"), large.select("key", "rep")


def _frequencies(column, row: np.ndarray) -> np.ndarray:
    """Document frequencies of the shingles of texts, whose rows are given, from a column of them."""
    packed = column.to_pylist()
    return np.concatenate([np.empty(0, np.int64), *map(_unpacked, packed, np.bincount(row, minlength=len(packed)).tolist())])


def weighted_jaccard(left, right, n_documents: int) -> np.ndarray:
    """Similarity of the texts of two blocks (bytes, offsets, frequencies), row by row; 0 where one has no words."""
    n = len(left[1]) - 1
    (ra, ka, ta), (rb, kb, tb) = weighted_shingles(*left[:2]), weighted_shingles(*right[:2])
    wa, wb = ta * idf(_frequencies(left[2], ra), n_documents), tb * idf(_frequencies(right[2], rb), n_documents)
    ka, kb = (ra.astype(U64) << U64(48)) | ka, (rb.astype(U64) << U64(48)) | kb
    both = np.zeros(n)
    if len(ka) and len(kb):
        at = np.searchsorted(ka, kb)
        at[at == len(ka)] = 0
        hit = ka[at] == kb
        both = np.bincount(rb[hit], np.minimum(wa[at[hit]], wb[hit]), n)
    total = np.bincount(ra, wa, n) + np.bincount(rb, wb, n) - both
    return np.divide(both, total, out=np.zeros(n), where=total > 0)


def weighed_texts(documents: DataFrame, marked: DataFrame, needed: DataFrame, n_documents: int) -> DataFrame:
    """(doc_id, text, df) of the needed ids: their texts with words and the document frequencies of their shingles."""
    # ids without the hash of a needed one go before the joins, which would shuffle all texts: HASH_BITS bits a document
    place = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_BITS * max(1, n_documents)))
    places = needed.select(place.alias("place"))
    # merge joins at every size: the ids and texts needed grow with the documents
    found = among(marked.filter("df IS NOT NULL").select("doc_id", "text_key", "df"), place, places, "place")
    found = found.join(needed.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text_key"])
    texts = among(documents.selectExpr("doc_id", "text", TEXT_KEY), place, places, "place")
    return texts.join(found.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text", "df")


def verified(pairs: DataFrame, documents: DataFrame, marked: DataFrame, n_documents: int) -> DataFrame:
    """(a, b, similarity) of the pairs whose whole texts are similar enough."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = written(weighed_texts(documents, marked, needed, n_documents), "minhash-texts")
    left, right = texts.selectExpr("doc_id AS a", "text AS ta", "df AS da"), texts.selectExpr("doc_id AS b", "text AS tb", "df AS db")
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")

    def run(batches):
        for batch in batches:
            right_column = batch.column("tb")
            for low, high, data, offsets in blocks(batch.column("ta"), rows=1024):
                for at, to, other, others in blocks(right_column[low:high]):
                    da, db = (batch.column(c)[low + at : low + to] for c in ("da", "db"))
                    left = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], da
                    score = weighted_jaccard(left, (other, others, db), n_documents)
                    keep = pa.array(score >= SIMILARITY)
                    part = [batch.column(c)[low + at : low + to].filter(keep) for c in ("a", "b")]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(score[score >= SIMILARITY])], names=["a", "b", "similarity"])

    columns = both.select("a", "b", "ta", "tb", "da", "db")
    return written(columns.mapInArrow(run, "a long, b long, similarity double"), "minhash-links")


def unlinked_links(
    large: DataFrame, nodes: DataFrame, documents: DataFrame, marked: DataFrame, n_documents: int
) -> DataFrame | None:
    """Links (a, b) between components of ``nodes`` (rep, component) that have similar texts in one large bucket; None if
    every large bucket (key, rep) lies in one component.

    All members outside a bucket's largest component are compared with all members of other components, in cells of
    two segments. The comparisons are quadratic in a bucket of texts that are alike but not near-duplicates.
    """
    placed = large.join(nodes, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("m"))
    mains = sizes.groupBy("key").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.count("*").alias("parts"))
    members = placed.join(mains.filter("parts > 1"), "key").withColumn("rest", F.col("part") != F.col("main"))
    members = written(members.select("key", "rep", "part", "rest"), "minhash-unlinked")
    if members.isEmpty():
        return None
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = weighed_texts(documents, marked, needed, n_documents).withColumnRenamed("doc_id", "rep")
    texts = written(texts, "minhash-unlinked-texts")
    sized = members.join(texts.select("rep", F.octet_length("text").alias("bytes")).hint("merge"), "rep")

    def segments(n, size):
        return F.greatest(F.lit(1), F.ceil(n / SEGMENT), F.ceil(F.coalesce(size, F.lit(0)) / SEGMENT_BYTES)).cast("long")

    cuts = sized.groupBy("key").agg(
        segments(F.count("*"), F.sum("bytes")).alias("n_all"),
        segments(F.count_if("rest"), F.sum(F.when(F.col("rest"), F.col("bytes")))).alias("n_rest"),
    )
    members = members.join(cuts, "key")

    def placed_at(side: bool, i, j):
        rows = members.filter("rest") if side else members
        return rows.select("key", "rep", "part", "rest", F.lit(side).alias("left"), i.alias("i"), "n_all", "n_rest").select(
            "key", "rep", "part", "rest", "left", "i", j.alias("j")
        )

    def own(n):
        return F.pmod(F.xxhash64("rep"), F.col(n))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    cells = placed_at(True, own("n_rest"), every("n_all")).union(placed_at(False, every("n_rest"), own("n_all")))
    cells = cells.join(texts.hint("merge"), "rep").select("key", "i", "j", "rep", "part", "rest", "left", "text", "df")

    def run(cell: pa.Table) -> pa.Table:
        rep, part, rest, left = (cell.column(c).to_numpy() for c in ("rep", "part", "rest", "left"))
        n = len(rep)
        data, offsets = text_arrays(cell.column("text"))
        row, key, tf = weighted_shingles(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        weight = tf * idf(_frequencies(cell.column("df"), row), n_documents)
        total, first = np.bincount(row, weight, n), np.searchsorted(row, np.arange(n + 1))
        at = np.flatnonzero(~left[row])
        at = at[np.argsort(key[at], kind="stable")]
        other_key, other_row, other_weight = key[at], row[at], weight[at]
        found = set()
        for x in np.flatnonzero(left).tolist():
            k, w = key[first[x] : first[x + 1]], weight[first[x] : first[x + 1]]
            low, high = (np.searchsorted(other_key, k, side) for side in ("left", "right"))
            hit = ragged(low, high - low)
            both = np.bincount(other_row[hit], np.minimum(other_weight[hit], np.repeat(w, high - low)), n)
            near = both >= SIMILARITY * (total[x] + total - both)
            # two members of the rest meet in two orders
            near &= ~left & (part != part[x]) & (~rest | (rep > rep[x])) & (both > 0)
            found.update((min(p, part[x]), max(p, part[x])) for p in part[near])
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = cells.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()
    return written(links, "minhash-unlinked-links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, kept.

    ``class_id`` is the smallest doc_id of the documents connected by links of weighted Jaccard similarity 0.8 or more;
    ``kept`` marks that document. Words are runs of other than white space, ASCII letters lower-cased; a text of fewer
    than five words is one shingle. Null texts and texts without words are classes of their own, as are rows without
    id (class null). Rows that repeat an id count as one document. Other columns are not read.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = written(signatures(documents), "minhash-signatures")
    n_documents = marked.filter("bag1 IS NOT NULL").count()
    usable = marked.filter("bag1 IS NOT NULL AND doc_id IS NOT NULL")
    reps = usable.groupBy("bag1", "bag2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    reps = written(reps, "minhash-reps")
    pairs, large = candidate_pairs(reps.select("rep", "bands"))
    links = verified(pairs, documents, marked, n_documents).select("a", "b")
    nodes = components(links, "minhash-components").withColumnRenamed("node", "rep")
    more = unlinked_links(large, nodes, documents, marked, n_documents)
    if more is not None:
        nodes = components(links.union(more), "minhash-components").withColumnRenamed("node", "rep")
    classes = reps.select("bag1", "bag2", "rep").join(nodes, "rep", "left")
    # an id with several texts has several nodes: its smallest class holds for all
    found = usable.select("doc_id", "bag1", "bag2").join(classes, ["bag1", "bag2"])
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id"))
    out = marked.select("doc_id").join(found, "doc_id", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
