"""N-gram Jaccard join: classes of documents whose sets of five-word shingles are similar.

The document by shingle incidence is never squared as a whole.  Three exact reductions come first.

1. Rare shingles first.  Documents that link share one of the rarest ``n - ceil(t * n) + 1`` shingles of each.
   Incidence is dealt by ranges of the shingles' hashes, in packed blocks; a range counts its shingles'
   documents and drops those of one document.  A document whose rarest shingles are all its own has no partner
   and leaves.  Shingles that a batch finds very frequent are counted beside it, from a list of proven size,
   so that no range holds a crowd.
2. Equal sets count once: the smallest id of each digest stands for its copies.
3. Families.  What remains is joined to the smallest id of each of its rarest shingles (a star, not all
   pairs), and connected components of these stars are families: no link leaves one.

Within a family overlap counts are a sparse matrix product, blocks of columns at a time; pairs below the bound
that their sizes set are discarded, and of the links a task returns a spanning forest only.  Large families are
dealt as pairs of blocks of documents.  Components of the forests are the classes.

Shingles are compared by 64-bit hashes of their words' hashes; a range keeps all of them up to 2**36 incidences'
worth of ranges, and 48 bits below a range's number before that.

Defined results: texts that are null or hold no word have an empty set and stay alone; texts of fewer words than
a shingle have one shingle, the whole; rows without doc_id take no part and have no class (null); rows of one
doc_id are one node, to which all of their texts belong, and each has its own n_shingles; an empty table gives
no rows; other columns, whatever their names, are neither read nor returned.  ``deduplicated`` keeps of a doc_id
with several rows the one whose text is the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_arrow, partitions_for, unsized

WORDS, PERCENT = 5, 75
#: Bounds of a packed batch: documents and bytes of text.
BATCH_DOCUMENTS, BATCH_BYTES = 16_384, 6 << 20
#: Bytes of text whose words exist at once; a longer text is a part of its own.
PART_BYTES = 1 << 20
#: Incidences in one range of hashes, and bits of a hash that are kept below its range at most.
RANGE, LOW_BITS, LEAST_RANGE_BITS = 1 << 20, 48, 4
#: A shingle is listed by a batch if one in so many of its documents holds it, and is frequent if one in so many of all do.
LOCAL, FREQUENT, LEAST = 50, 100, 64
#: Members of a family that one task compares at once, members of a block of a larger one, and members of a task.
SMALL, BLOCK, TASK = 400, 200, 4000
COLUMNS = 8192

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[bytes | None], memo: dict) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text or b"")
        if size >= PART_BYTES:
            out += _sets_of(part, memo)
            part, size = [], 0
    return out + _sets_of(part, memo)


def _sets_of(texts: list[bytes | None], memo: dict) -> list[np.ndarray]:
    if len(memo) > 200_000:
        memo.clear()
    # bytes.lower touches A-Z only, and bytes.split cuts at ASCII white space only
    words = [(t or b"").lower().split() for t in texts]
    flat = [w for own in words for w in own]
    hashes = np.fromiter(map(memo.__getitem__, flat), np.uint64, len(flat))
    if len(flat) >= WORDS:
        windows = hashes[: len(flat) - WORDS + 1] * _FACTORS[0]
        for k in range(1, WORDS):
            windows += hashes[k : len(flat) - WORDS + 1 + k] * _FACTORS[k]
        windows = _mixed(windows)
    out, at = [], 0
    for own in words:
        n = len(own)
        if n >= WORDS:
            out.append(np.unique(windows[at : at + n - WORDS + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=n)], np.uint64))
        else:
            out.append(np.array([], np.uint64))
        at += n
    return out


def _batches(batches):
    """(ids, texts) in bounded batches."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        start, size = 0, 0
        sizes = [v or 0 for v in pc.binary_length(texts).to_pylist()]
        for i, own in enumerate(sizes):
            if i > start and (size + own > BATCH_BYTES or i - start >= BATCH_DOCUMENTS):
                yield ids[start:i], texts.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += own
        if len(ids) > start:
            yield ids[start:], texts.slice(start).to_pylist()


def _digest(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def describe(documents: DataFrame) -> DataFrame:
    """doc_id, n and digest of every row; a batch's first row also lists its frequent shingles."""
    memo = _Words()

    def run(batches):
        for ids, texts in _batches(batches):
            sets = shingle_sets(texts, memo)
            digests = [_digest(s) for s in sets]
            distinct = list({d: s for d, s in zip(digests, sets) if d}.values())
            frequent = b""
            if len(distinct) >= LEAST:
                values, counts = np.unique(np.concatenate(distinct), return_counts=True)
                many = counts >= max(LEAST, len(distinct) // LOCAL)
                frequent = np.c_[values[many], counts[many].astype(np.uint64)].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array([frequent] + [None] * (len(ids) - 1), pa.binary())], ["doc_id", "n", "digest", "frequent"])

    return in_arrow(_texts(documents), run, "doc_id long, n long, digest binary, frequent binary")


def frequent_shingles(described: DataFrame, documents: int) -> np.ndarray:
    """Hashes and counts, rarest first, of shingles in at least one in FREQUENT documents.

    At most FREQUENT times the mean set size: the list is bounded however large the corpus is.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                pairs = np.frombuffer(data, np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["h", "n"])

    lists = in_arrow(described.select("frequent").filter("length(frequent) > 0"), run, "h long, n long")
    sums = lists.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(LEAST, documents // FREQUENT))
    rows = sorted((r.n, r.h) for r in sums.collect())
    return np.array([(np.int64(h).view(np.uint64), n) for n, h in rows], np.uint64).reshape(-1, 2)


def _pack(values: np.ndarray, index: np.ndarray) -> bytes:
    """48-bit values in order and 16-bit indexes, byte plane by byte plane, which compresses well."""
    planes = np.c_[values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:], index.astype(">u2").view(np.uint8).reshape(-1, 2)]
    return planes.T.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    values = np.zeros((len(planes), 8), np.uint8)
    values[:, 2:] = planes[:, :6]
    return values.view(">u8").ravel().astype(np.uint64), np.ascontiguousarray(planes[:, 6:]).view(">u2").ravel().astype(np.int64)


def partners(documents: DataFrame, described: DataFrame) -> DataFrame:
    """Rows that may have a partner: doc_id, n, digest, rare (its rarest shared shingles) and ids (all shared ones)."""
    rows, total = described.agg(F.count("*"), F.sum("n")).first()
    frequent = frequent_shingles(described, rows)
    bits = max(LEAST_RANGE_BITS, ((total or 0) // RANGE).bit_length())
    ranges = 1 << bits
    # from 2**16 ranges on, a range's number leaves less than LOW_BITS of a hash, and all of them are kept
    low_bits = min(LOW_BITS, 64 - bits)
    cut = np.uint64(64 - bits - low_bits)
    sent = documents.sparkSession.sparkContext.broadcast(frequent)
    memo = _Words()

    def deal(batches):
        order = np.argsort(sent.value[:, 0])
        known = sent.value[order, 0]
        names = ["key", "batch", "kind", "data"]
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _batches(batches):
            sets: dict[bytes, tuple[int, np.ndarray]] = {}
            for i, own in zip(ids, shingle_sets(texts, memo)):
                if i is not None and len(own):
                    digest = _digest(own)
                    if digest not in sets or i < sets[digest][0]:
                        sets[digest] = i, own
            if not sets:
                continue
            number += 1
            flat = np.concatenate([s for _, s in sets.values()])
            lengths = np.array([len(s) for _, s in sets.values()])
            index = np.repeat(np.arange(len(sets)), lengths)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            common = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            places = order[at[common]].astype(np.uint32) if len(known) else np.array([], np.uint32)
            head = np.array([len(sets), common.sum()], np.int64).tobytes() + np.array([i for i, _ in sets.values()], np.int64).tobytes() + lengths.astype(np.int64).tobytes() + b"".join(sets)
            out = [(ranges + number, number, 1, head + index[common].astype(np.uint32).tobytes() + places.tobytes())]
            flat, index = flat[~common], index[~common]
            sort = np.argsort(flat)
            flat, index = flat[sort] >> cut, index[sort]
            part = flat >> np.uint64(low_bits)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(flat)] if len(flat) else [0]
            low = flat & np.uint64((1 << low_bits) - 1)
            for a, b in zip(edges, edges[1:]):
                out.append((int(part[a]), number, 0, _pack(low[a:b], index[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)

    def count(group: pa.Table) -> pa.Table:
        """Shingles of one range that two documents or more hold, back to their batches."""
        names, kinds = ["batch", "kind", "data"], (pa.int64(), pa.int32(), pa.binary())
        key = group.column("key")[0].as_py()
        batches, data = group.column("batch").to_pylist(), group.column("data").to_pylist()
        if key >= ranges:
            out = [(b, 1, d) for b, d in zip(batches, data)]
        else:
            unpacked = [_unpack(d) for d in data]
            values = np.concatenate([v for v, _ in unpacked])
            lengths = [len(v) for v, _ in unpacked]
            _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
            often, out, at = counts[inverse], [], 0
            for b, (v, i), n in zip(batches, unpacked, lengths):
                own = often[at : at + n]
                at += n
                if (shared := own > 1).any():
                    ids = v[shared] | np.uint64(key << low_bits)
                    out.append((b, 0, ids.tobytes() + i[shared].astype(np.uint32).tobytes() + own[shared].astype(np.uint32).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [(), (), ()], kinds)], names)

    def select(group: pa.Table) -> pa.Table:
        """Of one batch: documents whose rarest shingles are not all their own."""
        head, entries = None, []
        for kind, data in zip(group.column("kind").to_pylist(), group.column("data").to_pylist()):
            if kind:
                head = data
            else:
                n = len(data) // 16
                entries.append((np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.uint32, n, 12 * n)))
        n, m = np.frombuffer(head, np.int64, 2)
        doc_ids, lengths = np.frombuffer(head, np.int64, n, 16), np.frombuffer(head, np.int64, n, 16 + 8 * n)
        digests = [head[16 + 16 * n + 16 * k : 32 + 16 * n + 16 * k] for k in range(n)]
        at = 16 + 32 * int(n)
        index, places = np.frombuffer(head, np.uint32, m, at), np.frombuffer(head, np.uint32, m, at + 4 * int(m))
        # frequent shingles come after all others, in the order of their list
        entries.append((sent.value[places, 0] >> cut, index, np.uint64(1 << 32) + places))
        ids, index, often = (np.concatenate([e[k] for e in entries]) for k in range(3))
        sort = np.lexsort((ids, often, index))
        ids, index = ids[sort], index[sort]
        first = np.searchsorted(index, np.arange(n + 1))
        out = []
        for k in range(n):
            own = ids[first[k] : first[k + 1]]
            prefix = lengths[k] - -(-PERCENT * lengths[k] // 100) + 1 - (lengths[k] - len(own))
            if prefix > 0:
                out.append((int(doc_ids[k]), int(lengths[k]), digests[k], own[:prefix].view(np.int64).tolist(), np.sort(own).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["doc_id", "n", "digest", "rare", "ids"])

    dealt = in_arrow(_texts(documents), deal, "key long, batch long, kind int, data binary")
    counted = dealt.repartition(min(ranges, partitions_for(total, 4 * RANGE)), "key").groupBy("key").applyInArrow(count, "batch long, kind int, data binary")
    return counted.groupBy("batch").applyInArrow(select, "doc_id long, n long, digest binary, rare array<long>, ids binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b): node and component, the smallest node that it reaches.

    Labels take the smallest label of their neighbours, then their label's own label, until none changes.
    """
    both = unsized(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct())
    labels = unsized(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        above = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        new = unsized(better.join(above, better["label"] == above["up"], "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def links(ids: list[np.ndarray], sizes: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Matrix of links; with ``apart`` (a block number each) only between different blocks."""
    m = len(ids)
    values, column = np.unique(np.concatenate(ids), return_inverse=True)
    row = np.repeat(np.arange(m), [len(x) for x in ids])
    shared = np.bincount(column, minlength=len(values)) > 1
    dense = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((m, m), np.float32)
    width = int(shared.sum())
    for a in range(0, width, COLUMNS):
        part = slice(*np.searchsorted(column, (a, a + COLUMNS)))
        block = np.zeros((m, min(COLUMNS, width - a)), np.float32)
        block[row[part], column[part] - a] = 1
        overlap += block @ block.T
    overlap = overlap.astype(np.int64)
    found = 100 * overlap >= PERCENT * (sizes[:, None] + sizes[None, :] - overlap)
    np.fill_diagonal(found, False)
    if apart is not None:
        found &= apart[:, None] != apart[None, :]
    return found


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it reaches."""
    m = len(linked)
    labels = np.arange(m)
    while True:
        near = np.where(linked, labels[None, :], m).min(axis=1, initial=m)
        new = np.minimum(labels, near)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _repeated_ids(described: DataFrame, stands: DataFrame) -> DataFrame | None:
    """Edges from each doc_id with several different sets to the representatives of these; none if there is no such id."""
    held = described.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest")
    several = checkpointed(held.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one <> other").select("doc_id"))
    if several.isEmpty():
        return None
    return held.join(several, "doc_id", "left_semi").join(stands, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def jaccard_classes(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    described = checkpointed(describe(documents))
    # a stage of its own, so that the join below can split what a crowd of copies sends to one task
    stands = checkpointed(described.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    # of a batch's copies the one of the smallest id comes here, so a crowd of copies meets its representative by both keys
    alike = partners(documents, described).withColumnRenamed("doc_id", "rep").join(stands, ["digest", "rep"], "left_semi").dropDuplicates(["digest", "rep"])
    alike = checkpointed(alike.select("rep", "n", "rare", "ids"))
    held = alike.select("rep", F.explode("rare").alias("shingle"))
    stars = held.groupBy("shingle").agg(F.min("rep").alias("star"), F.count("*").alias("c")).filter("c > 1")
    edges = held.join(checkpointed(stars), "shingle").filter("rep <> star").select(F.col("rep").alias("a"), F.col("star").alias("b")).distinct()
    families = connected_components(edges)
    # texts of one doc_id share their rep and so their family
    joined = checkpointed(alike.select("rep", "n", "ids").join(families, F.col("rep") == F.col("node")).select("rep", "n", "ids", F.col("component").alias("family")))
    sizes = joined.groupBy("family").agg(F.count("*").alias("members"))
    members = joined.join(sizes, "family")
    tasks = partitions_for(joined.count(), TASK)
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    small = F.col("members") <= SMALL
    placed = members.withColumn("block", F.when(small, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("rep"), blocks)))
    spread = placed.withColumn("other", F.explode(F.when(small, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))))
    task = F.when(small, F.pmod(F.xxhash64("family"), F.lit(tasks))).otherwise(F.col("family") + tasks)
    spread = spread.select("rep", "n", "ids", "family", "block", task.alias("task"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(group: pa.Table) -> pa.Table:
        rep, n = (group.column(c).to_numpy() for c in ("rep", "n"))
        family, block = (group.column(c).to_numpy() for c in ("family", "block"))
        ids = [np.frombuffer(x, np.uint64) for x in group.column("ids").to_pylist()]
        crossed = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        order = np.lexsort((rep, family))
        edges = np.flatnonzero(np.r_[True, family[order][1:] != family[order][:-1]]).tolist() + [len(order)]
        a, b = [], []
        for start, end in zip(edges, edges[1:]):
            own = order[start:end]
            if len(own) > 1:
                roots = forest(links([ids[k] for k in own], n[own], block[own] if crossed else None))
                moved = np.flatnonzero(roots != np.arange(len(own)))
                a.append(rep[own[moved]])
                b.append(rep[own[roots[moved]]])
        both = [np.concatenate(x) if x else np.array([], np.int64) for x in (a, b)]
        return pa.table([pa.array(x, pa.int64()) for x in both], ["a", "b"])

    found = spread.groupBy("task", "low", "high").applyInArrow(compare, "a long, b long")
    several = _repeated_ids(described, stands)
    classes = connected_components(found if several is None else found.unionByName(several))
    of_sets = checkpointed(stands.join(classes, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("class")))
    rows = described.join(of_sets, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
    if several is None:
        return rows
    # an empty text of such a doc_id belongs to its node as well
    ids = classes.join(several.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("doc_id"), "component")
    return rows.join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each class, the one of the smallest doc_id; rows without doc_id stay."""
    stay = jaccard_classes(documents).filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__stay")).agg(F.count("*").alias("__rows"))
    stay = checkpointed(stay)
    key = documents["doc_id"].cast("long")
    whole = documents.join(stay.filter("__rows = 1").select("__stay"), key == F.col("__stay"), "left_semi").unionByName(documents.filter(key.isNull()))
    if stay.filter("__rows > 1").isEmpty():
        return whole
    several = documents.join(stay.filter("__rows > 1").select("__stay"), key == F.col("__stay"), "left_semi")
    first = several.groupBy(F.col("doc_id").alias("__stay")).agg(F.min_by(F.struct(*documents.columns), F.struct(F.col("text").isNull(), "text")).alias("__row"))
    return whole.unionByName(first.select("__row.*"))
