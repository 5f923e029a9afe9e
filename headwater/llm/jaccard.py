"""Chosen-path join: all pairs of documents whose sets of five-word shingles are at least 0.8 similar.

Equal sets are one record from the start. A record is represented by the least hash of its shingles
under each of 64 hash functions; two records share such a token with the probability of their
similarity. A run samples one token position and puts records that share its token into one bucket;
a bucket that is too large samples positions anew, by its own path, and splits again. Small buckets
are compared by brute force. Runs are repeated until a pair at the threshold is met with the target
recall. A pair is checked on its whole sets in the first bucket where it meets, so each link counts
once, and no row holds a pair: buckets give sums of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import Scratch, forget_others, map_batches, ship_package, texts_of, unpacked

WORDS = 5
SIMILAR = 0.8
TOKENS = 64
FANOUT = 2  # positions that a bucket samples when it splits
DEPTH = 3
BUCKET = 512  # records that are compared by brute force at once
TARGET_RECALL = 0.9999
# Pairs with fewer shared tokens are not checked further: at the threshold 51 of 64 are expected,
# and fewer than 36 have a probability of about 1e-6.
LEAST_SHARED = 36
KEPT_WORDS = 300_000


def runs_needed(recall: float = TARGET_RECALL) -> int:
    """Runs until a pair at the threshold is met with this probability, however deep its buckets split."""
    stays = 1.0
    for _ in range(DEPTH - 1):
        stays = 1 - (1 - SIMILAR * stays) ** FANOUT
    return math.ceil(math.log(1 - recall) / math.log(1 - SIMILAR * stays))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


_word_hashes: dict[str, int] = {}


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of five words (of all its words if there are fewer).

    Words are cut at white space, and letter case is ignored. The runs of all texts are hashed
    together; those that would reach into the next text are left out.
    """
    cut = [t.lower().split() for t in texts]
    known = _word_hashes
    if len(known) > KEPT_WORDS:
        known.clear()
    for words in cut:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    sizes = [len(words) for words in cut]
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.uint64, sum(sizes))

    def runs(of: np.ndarray, words: int) -> np.ndarray:
        n = max(len(of) - words + 1, 0)
        out = np.full(n, words, np.uint64)
        for k in range(words):
            out = mixed(out ^ of[k : k + n])
        return out

    long_runs = runs(hashes, WORDS)
    sets, at = [], 0
    for size in sizes:
        if size >= WORDS:
            sets.append(np.unique(long_runs[at : at + size - WORDS + 1]))
        else:
            sets.append(runs(hashes[at : at + size], size) if size else np.empty(0, np.uint64))
        at += size
    return sets


def shingle_set(text: str) -> np.ndarray:
    return shingle_sets([text])[0]


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64))
    return (seeds[:TOKENS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[TOKENS:] >> np.uint64(32)).astype(np.uint32)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of tokens (16 bits each) per set; sets must not be empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), TOKENS), np.uint16)
    for t, (a, b) in enumerate(zip(*_functions(), strict=True)):
        out[:, t] = (np.minimum.reduceat((values * a) ^ b, starts) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def _set_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per document: id, size and two checksums of its set, sketch (null for an empty set)."""
    sets = shingle_sets(texts_of(batch.column(1)))
    full = [i for i, s in enumerate(sets) if len(s)]
    tokens: list[bytes | None] = [None] * len(sets)
    if full:
        for i, row in zip(full, sketches([sets[i] for i in full]), strict=True):
            tokens[i] = row.tobytes()
    with np.errstate(over="ignore"):
        first = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        second = [int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
    columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(tokens, pa.binary())]
    return pa.record_batch(columns, ["id", "n", "k1", "k2", "tokens"])


def _path(path: np.ndarray, position: np.ndarray | int, token: np.ndarray) -> np.ndarray:
    """The child of a path by the token at a position."""
    return mixed(path ^ mixed((np.uint64(position) << np.uint64(16) | token.astype(np.uint64)) + np.uint64(1)))


def _token_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def _first_paths(runs: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Each run samples its own position at the root."""
    positions = np.argsort(mixed(np.arange(1000, 1000 + TOKENS, dtype=np.uint64)))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, recs = _token_matrix(batch.column(1)), batch.column(0).to_numpy()
        paths = [_path(np.full(len(recs), r, np.uint64), int(positions[r % TOKENS]), tokens[:, positions[r % TOKENS]]) for r in range(runs)]
        return pa.record_batch([pa.array(np.concatenate(paths).astype(np.int64)), pa.array(np.tile(recs, runs))], ["path", "rec"])

    return rows


def _split_paths(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A path samples its own positions, the same for all its records and different from each other, so that no child comes twice."""
    paths, recs, tokens = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy(), _token_matrix(batch.column(2))
    out, taken = [], np.empty((0, len(paths)), np.int64)
    for k in range(FANOUT):
        # One of the positions that are left: a number below their count, moved past each smaller one that is taken.
        positions = (mixed(paths + np.uint64(k + 1)) % np.uint64(TOKENS - k)).astype(np.int64)
        for before in taken:
            positions += positions >= before
        taken = np.sort(np.vstack([taken, positions]), axis=0)
        out.append(_path(paths, positions, tokens[np.arange(len(recs)), positions]))
    return pa.record_batch([pa.array(np.concatenate(out).astype(np.int64)), pa.array(np.tile(recs, FANOUT))], ["path", "rec"])


def groups_of(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Run ``fn`` on the rows of each key, which must be few; keys are dealt to tasks by hash and come sorted.

    One Python call per batch rather than per group: most groups have two or three rows.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    ship_package(df.sparkSession)

    def out(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}, schema=like)

    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    like = pa.schema([(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def bounds(table: pa.Table) -> np.ndarray:
            cols = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(table.num_rows, bool)
            change[:1] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            return np.append(np.flatnonzero(change), table.num_rows)

        def work(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    part = table.slice(a, b - a)
                    rows += fn(tuple(part.column(k)[0].as_py() for k in keys), part)
                if len(rows) >= 2000:
                    yield out(rows, like)
                    rows = []
            if rows:
                yield out(rows, like)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table]).combine_chunks()
            edges = bounds(table)
            if len(edges) > 2:
                yield from work(table, edges[:-1])
            rest = table.slice(edges[-2]).combine_chunks() if len(edges) > 1 else None
        if rest is not None and rest.num_rows:
            yield from work(rest, bounds(rest))
        # The worker may stay idle for the stages that follow, beside a JVM that needs the room.
        rest = None
        forget_others()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _candidates(key: tuple, part: pa.Table) -> list[tuple]:
    """Records of a bucket that have pairs to check here, each with its later partners: enough tokens shared, and no earlier bucket shared."""
    leaf, one, two = key
    recs, sizes, blocks = part.column("rec").to_numpy(), part.column("n").to_numpy(), part.column("block").to_numpy()
    tokens = _token_matrix(part.column("tokens"))
    m = len(recs)
    leaves = part.column("leaves").to_pylist()
    near: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, 4_000_000 // (m * TOKENS))
    for a in range(0, m, step):
        shared = (tokens[a : a + step, None, :] == tokens[None, :, :]).sum(axis=2)
        i, j = np.nonzero(shared >= LEAST_SHARED)
        near.append((i + a, j))
    i, j = np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near])
    least, most = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = (recs[i] < recs[j]) & (least >= SIMILAR * most)
    if one != two:
        keep &= blocks[i] != blocks[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    # Buckets that come before this one and hold two or more of these records.
    used = np.unique(np.concatenate([i, j]))
    owner = np.concatenate([np.full(len(leaves[u]), at) for at, u in enumerate(used)])
    ids = np.concatenate([np.asarray(leaves[u], np.int64) for u in used])
    before = ids < leaf
    values, number, times = np.unique(ids[before], return_inverse=True, return_counts=True)
    if (times > 1).any():
        place = np.full(m, -1)
        place[used] = np.arange(len(used))
        met = np.zeros((len(used), len(used)), np.float32)
        several = np.cumsum(times > 1) - 1
        wide = int((times > 1).sum())
        keep = times[number] > 1
        rows, cols = owner[before][keep], several[number[keep]]
        for start in range(0, wide, 2048):
            block = np.zeros((len(used), min(2048, wide - start)), np.float32)
            inside = (cols >= start) & (cols < start + 2048)
            block[rows[inside], cols[inside] - start] = 1
            met += block @ block.T
        first = met[place[i], place[j]] == 0
        i, j = i[first], j[first]
    partners: dict[int, list[int]] = {int(x): [] for x in np.unique(np.concatenate([i, j]))} if len(i) else {}
    for a, b in zip(i.tolist(), recs[j].tolist(), strict=True):
        partners[a].append(b)
    return [(leaf, one, two, int(recs[a]), p) for a, p in partners.items()]


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(i) < 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = np.cumsum(times > 1) - 1
    keep = times[number] > 1
    order = np.argsort(several[number[keep]], kind="stable")
    cols, rows = several[number[keep]][order], owner[keep][order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, 16_000_000 // len(sets))
    for start in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(cols, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[rows[a:b], cols[a:b] - start] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64)


def _links(key: tuple, part: pa.Table) -> list[tuple]:
    """Check the pairs of a bucket on their sets: per record its links (weighted by copies) and the least record it hangs together with."""
    rows = {r: (p, s, c) for r, p, s, c in zip(*(part.column(n).to_pylist() for n in ("rec", "partners", "hashes", "copies")), strict=True)}
    recs = sorted(rows)
    at = {r: k for k, r in enumerate(recs)}
    sets = [np.frombuffer(rows[r][1], np.uint64) for r in recs]
    pairs = [(at[r], at[p]) for r in recs for p in rows[r][0] if p in at]
    i, j = np.array(pairs, np.int64).reshape(-1, 2).T
    if not len(i):
        return []
    both = shared_counts(sets, i, j)
    sizes = np.array([len(s) for s in sets])
    # Whole numbers, so that 4 in 5 is exactly at the threshold.
    linked = 10 * both >= 8 * (sizes[i] + sizes[j] - both)
    i, j = i[linked], j[linked]
    copies = np.array([rows[r][2] for r in recs])
    links = np.bincount(i, weights=copies[j], minlength=len(recs)) + np.bincount(j, weights=copies[i], minlength=len(recs))
    root = np.arange(len(recs))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(recs[k], int(links[k]), recs[int(root[k])]) for k in np.flatnonzero(links)]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(rec, root)``: the least node that each node of ``edges(rec, root)`` is connected with.

    Every round takes the least label among the neighbours and then the label of that label. Labels
    are stored each round; nothing but the number of changed rows comes to the driver.
    """
    both = scratch.keep(edges.where("rec <> root").select(F.col("rec").alias("a"), F.col("root").alias("b")).union(edges.where("rec <> root").select("root", "rec")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("rec")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both.b == labels.rec).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.rec == near.a).select("rec", F.col("root").alias("old"), F.least("root", "near").alias("to"))
        jump = labels.select(F.col("rec").alias("to"), F.col("root").alias("beyond"))
        moved = lower.join(jump, "to", "left").select("rec", "old", F.least("to", F.coalesce("beyond", "to")).alias("root"))
        stored = scratch.keep(moved, f"labels{turn}")
        changed = stored.where("old <> root").limit(1).count()
        scratch.drop(f"labels{turn - 1}")
        labels = stored.select("rec", "root")
        if not changed:
            return labels


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, class_id, n_links)`` of every row.

    ``n_links``: other rows whose shingle sets have a Jaccard similarity of 0.8 or more, equal ones
    included. ``class_id``: the least key that a row is connected with over such links. A null or blank
    text has no shingles and no links; its class is its own key. A row with a null key takes no
    part: class null, no links. Repeated rows with one key and text link with each other. Columns
    with other names are not read. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    given = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    sets = scratch.keep(map_batches(given, _set_rows, f"id {kind}, n bigint, k1 bigint, k2 bigint, tokens binary"), "sets")
    part = sets.where("id IS NOT NULL AND n > 0")
    distinct = part.groupBy("n", "k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("tokens").alias("tokens"))
    records = scratch.keep(distinct.select(F.monotonically_increasing_id().alias("rec"), "*"), "records")
    tokens = records.select("rec", "tokens")

    # Level by level: small buckets are kept, large ones split, the last level is cut into blocks.
    level = map_batches(tokens, _first_paths(runs_needed()), "path bigint, rec bigint")
    kept = []
    for depth in range(DEPTH):
        level = scratch.keep(level, f"paths{depth}")
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = level.join(sizes, "path")
        if depth == DEPTH - 1:
            kept.append(sized)
        else:
            kept.append(sized.where(F.col("size") <= BUCKET))
            level = map_batches(sized.where(F.col("size") > BUCKET).join(tokens, "rec").select("path", "rec", "tokens"), _split_paths, "path bigint, rec bigint")
    buckets = scratch.keep(kept[0].unionByName(kept[1]).unionByName(kept[2]).select(F.col("path").alias("leaf"), "rec", "size"), "buckets")
    own = buckets.groupBy("rec").agg(F.collect_set("leaf").alias("leaves"))
    member = buckets.join(own, "rec").join(records.select("rec", "n", "tokens"), "rec")
    blocks = F.ceil(F.col("size") / BUCKET).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rec"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = member.select("leaf", "rec", "n", "tokens", "leaves", "block", other).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other")
    candidates = scratch.keep(groups_of(dealt, ["leaf", "one", "two"], _candidates, "leaf bigint, one int, two int, rec bigint, partners array<bigint>"), "candidates")

    wanted = records.join(candidates.select("rec").distinct(), "rec", "left_semi").select("rec", "n", "k1", "k2", "copies", F.col("first").alias("id"))
    texts = given.join(wanted, "id").select("rec", "n", "k1", "k2", "copies", "text")

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        # Rows of one key may have other texts too; the checksums tell them apart.
        fit = [(r, c, s.tobytes()) for r, n, k, c, s in zip(*(batch.column(x).to_pylist() for x in (0, 1, 2, 4)), shingle_sets(texts_of(batch.column(5))), strict=True) if len(s) == n and int(s.sum(dtype=np.uint64).astype(np.int64)) == k]
        if not fit:
            return None
        recs, copies, found = zip(*fit, strict=True)
        return pa.record_batch([pa.array(recs, pa.int64()), pa.array(copies, pa.int64()), pa.array(found, pa.binary())], ["rec", "copies", "hashes"])

    with_sets = candidates.join(map_batches(texts, hashes, "rec bigint, copies bigint, hashes binary"), "rec").select("leaf", "one", "two", "rec", "partners", "copies", "hashes")
    links = scratch.keep(groups_of(with_sets, ["leaf", "one", "two"], _links, "rec bigint, links bigint, root bigint"), "links")
    roots = components(links.select("rec", "root"), scratch)
    counted = records.join(links.groupBy("rec").agg(F.sum("links").alias("links")), "rec", "left").join(roots, "rec", "left")
    ranked = scratch.keep(counted.select("n", "k1", "k2", "first", F.coalesce("root", "rec").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "ranked")
    classes = ranked.join(ranked.groupBy("root").agg(F.min("first").alias("class")), "root").select("n", "k1", "k2", "class", "links")
    rows = sets.where("id IS NULL OR n = 0").select("id", F.col("id").alias("class"), F.lit(0).cast("bigint").alias("links"))
    linked = part.join(classes, ["n", "k1", "k2"]).select("id", "class", "links")
    return linked.unionByName(rows).select(F.col("id").alias(key), F.col("class").alias("class_id"), F.col("links").alias("n_links"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their columns, one of each class: that of the least ``doc_id``.

    Rows with a null id stay. Of rows that share id and class one stays. Null and empty texts are classes of their own. Rows travel as
    one struct, so columns may have any names; an empty table gives none.
    """
    heads = similar_documents(docs).where("doc_id = class_id").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    given = docs.select(F.col("doc_id").alias("id"), F.struct("*").alias("row"))
    kept = given.join(heads, "id")
    # Only ids that stand in several rows need their rows compared; all others pass without another shuffle.
    once = kept.where("rows = 1").select("row").unionByName(kept.where("rows > 1").dropDuplicates(["id"]).select("row"))
    return unpacked(once.unionByName(given.where("id IS NULL").select("row")), docs.columns)
