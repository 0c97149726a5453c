"""N-gram Jaccard join: a grouped prefix join whose links are gathered into components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scorelake.llm.common import written

#: Fixed odd multipliers, one per place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Shingles in more documents than this come last in the order, by their number.
COMMON = 32
#: So many common shingles are kept at most (12 MB); with more, only those in 2, 4, 8 ... times ``COMMON`` documents.
KEPT = 1_000_000
#: Ids of linked documents that are broadcast at most, to read their texts again.
BROADCAST_IDS = 1_000_000
#: Documents of one shingle's list that go to one group at most, about.
LIST_ROWS = 50_000
#: Shingles that a task counts before it passes them on.
HELD = 1_000_000


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``n``-word shingles, A-Z lower-cased; of fewer words, of all as one."""
    split = [(t or b"").lower().split() for t in texts]
    flat = np.empty(sum(map(len, split)), object)
    flat[:] = [w for words in split for w in words]
    hashes, out, at = pd.util.hash_array(flat, categorize=False), [], 0
    for words in split:
        h, at = hashes[at : at + len(words)], at + len(words)
        k = min(n, len(h))
        if not k:
            out.append(np.empty(0, np.uint64))
            continue
        total = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            total += h[j : len(h) - k + 1 + j] * PLACES[j]
        out.append(np.unique(mixed_bits(total + np.uint64(k))))
    return out


def parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and shingles of about a megabyte of text at a time."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // 1_000_000
        starts = [0, *np.flatnonzero(np.diff(ends)) + 1, batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if b > a:
                yield ids[a:b].to_pylist(), shingles(texts[a:b].to_pylist(), n)


def _counting(n: int, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            held.clear()
            bucket = tokens >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(2**63))) if len(tokens) else np.empty(0, int)
            rest = (tokens >> np.uint64(32 - bits)).astype("<u4")
            pay = [x.tobytes() for x in np.split(rest, starts[1:])] if len(tokens) else []
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.array(pay, pa.binary())], names=["bucket", "tokens"])

        for _, sets in parts(batches, n):
            held += sets
            size += sum(map(len, sets))
            if size > HELD:
                yield give()
                size = 0
        yield give()

    return count


def _common(bits: int, least: int):
    def common(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), "<u4") for g in groups for x in g.column("tokens")]
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        at = counts > least
        full = (np.uint64(key[0].as_py()) << np.uint64(32)) | tokens[at].astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(counts[at].astype(np.int64))], names=["token", "n"])

    return common


def common_shingles(docs: DataFrame, n: int, common: int = COMMON, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles (by their first 32 + bits bits) that most documents share, with their numbers.

    All shingles of all documents are counted, as sorted blocks of 32-bit words in as many buckets as the input asks
    for. Any order makes a right prefix filter, so that the number that is kept can be bounded: with more, the least
    common are ordered as rare ones."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, min(16, (size >> 21).bit_length()))
    counts = docs.mapInArrow(_counting(n, bits), "bucket long, tokens binary").groupBy("bucket").applyInArrow(_common(bits, common), "token long, n long")
    counts = written(counts, "common")
    least = common
    while counts.where(F.col("n") > least).count() > kept:
        least *= 2
    found = counts.where(F.col("n") > least).toPandas()
    found = found.sort_values("token")
    return found["token"].to_numpy(np.uint64), found["n"].to_numpy(np.uint32), bits


def _prefixes(n: int, percent: int, shared) -> object:
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, bits = shared.value
        for ids, sets in parts(batches, n):
            rows = []
            for id, s in zip(ids, sets):
                rank = np.zeros(len(s), np.uint32)
                if len(tokens) and len(s):
                    short = s >> np.uint64(32 - bits)
                    at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
                    rank = np.where(tokens[at] == short, counts[at], 0)
                order = np.argsort(rank, kind="stable")  # rare first, then by hash
                first = s[order[: len(s) - -(-len(s) * percent // 100) + 1]]
                whole = mixed_bits(s)
                same = [int(whole.sum() if len(s) else 0), int(np.bitwise_xor.reduce(whole * PLACES[0]) if len(s) else 0)]
                group = int(mixed_bits(first * PLACES[1]).sum()) if len(s) else 0
                rows.append((id, len(s), int((rank > 0).sum()), *(np.array([*same, group], np.uint64).view(np.int64).tolist()), first.astype("<u8").tobytes(), outline(s)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.binary()) for c in columns[6:])], names=["id", "n", "shared", "same1", "same2", "group", "prefix", "outline"])

    return prefixes


def outline(s: np.ndarray) -> bytes:
    """How many shingles lie in each part of the hash range, some two to a part: two sets have at most the sum of the
    lesser numbers in common, whatever the parts hold."""
    bits = max(1, len(s).bit_length() - 2)
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def _outlined(percent: int):
    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose outlines allow a link."""
        for batch in batches:
            keep = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                parts_ = min(len(x), len(y))
                x, y = (v.reshape(parts_, -1).sum(1, dtype=np.int64) for v in (x, y))
                most = int(np.minimum(x, y).sum())
                keep.append(100 * most >= percent * (n + m - most))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return outlined


def _long_lists(shared, list_rows: int):
    def long_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows are posted of each shingle that is in ``list_rows`` documents or more."""
        tokens, counts, bits = shared.value
        tokens = tokens[counts >= list_rows]
        posted = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                short = np.frombuffer(prefix, "<u8") >> np.uint64(32 - bits)
                at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
                np.add.at(posted, at[tokens[at] == short], 1)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[posted > 0].astype(np.int64)), pa.array(posted[posted > 0])], names=["token", "n"])

    return long_lists


def posted_rows(posted: DataFrame, shared, list_rows: int) -> np.ndarray:
    """Of each common shingle how many rows its list has, where that can be ``list_rows`` or more: copies aren't posted."""
    tokens, counts, _ = shared.value
    if not (counts >= list_rows).any():
        return counts
    found = posted.select("prefix").mapInArrow(_long_lists(shared, list_rows), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    rows = np.where(counts >= list_rows, 0, counts).astype(np.int64)
    rows[np.searchsorted(tokens, found["token"].to_numpy(np.uint64))] = found["n"].to_numpy(np.int64)
    return rows


def _postings(percent: int, shared, list_rows: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks by bucket: (first 32 bits after the bucket's, id, size, place, shared) of each prefix shingle. Lists
        of ``list_rows`` rows or more are dealt to several buckets by a hash of the id; the bits of a bucket from the
        20th on are 0 where a list is whole, and the number of its portion from one where it is dealt."""
        tokens, counts, bits = shared.value
        held, size = [], 0

        def give() -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.empty(0, POSTING + [("b", "<i8")])
            held.clear()
            rows = rows[np.argsort(rows["b"], kind="stable")]
            starts = np.flatnonzero(np.diff(rows["b"], prepend=-1))
            ends = [*starts[1:], len(rows)]
            pay = [b"".join(np.ascontiguousarray(rows[k][a:b]).tobytes() for k, _ in POSTING) for a, b in zip(starts, ends)]
            return pa.RecordBatch.from_arrays([pa.array(rows["b"][starts]), pa.array(pay, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for id, n, common, prefix in zip(*(batch.column(i).to_pylist() for i in range(4))):
                short = np.frombuffer(prefix, "<u8") >> np.uint64(32 - bits)
                rows = np.empty(len(short), POSTING + [("b", "<i8")])
                rows["b"], rows["t"], rows["id"], rows["n"], rows["at"] = short >> np.uint64(32), short & np.uint64(2**32 - 1), id, n, np.arange(len(short))
                rows["shared"] = 255 - min(255, 255 * common // max(n, 1))
                if common and len(tokens):
                    at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
                    dealt = np.where(tokens[at] == short, counts[at] // list_rows + 1, 1).astype(np.int64)
                    portion = (int(mixed_bits(np.array([id], np.int64).view(np.uint64))[0]) >> 8) % dealt + 1
                    rows["b"] += np.where(dealt > 1, portion, 0) << 20
                held.append(rows)
                size += len(rows)
            if size > HELD:
                yield give()
                size = 0
        yield give()

    return postings


POSTING = [("t", "<u4"), ("id", "<i8"), ("n", "<u4"), ("at", "<u4"), ("shared", "u1")]


def block(payload: bytes) -> np.ndarray:
    n, at = len(payload) // 21, 0
    rows = np.empty(n, POSTING)
    for name, kind in POSTING:
        width = np.dtype(kind).itemsize
        rows[name] = np.frombuffer(payload, kind, n, at)
        at += width * n
    return rows


def _lists(payloads: list[bytes], least: int) -> Iterator[np.ndarray]:
    rows = np.concatenate([block(p) for p in payloads])
    rows = rows[np.lexsort((rows["id"], rows["n"], rows["t"]))]
    starts = np.flatnonzero(np.diff(rows["t"].astype(np.int64), prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        if b - a >= least:
            yield rows[a:b]


def can_link(n, at, m, other, percent: int):
    """By sizes, and by what can be equal from a common shingle's places on. If it is the first that two sets share,
    that is all they share; so two that link pass in that shingle's list, and needn't in the others."""
    most = np.minimum(n - at, m - other)
    return (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & ((100 + percent) * most >= percent * (n + m))


def _stars(percent: int, common: int):
    def stars(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) to verify: all of a short list. Of a long one, each class of sizes with its most central row
        (whose shingles others share most), and these with each other; its rows are also given, for what is left. A
        portion of a dealt list counts as long, even with one row: its rows have partners in other portions."""
        pairs, long = [], []
        bucket, dealt = np.int64(key[0].as_py() & (1 << 20) - 1) << np.int64(32), key[0].as_py() >> 20 > 0
        for rows in _lists([x.as_py() for g in groups for x in g.column("rows")], 1 if dealt else 2):
            id, n, at = rows["id"], rows["n"].astype(np.int64), rows["at"].astype(np.int64)
            if len(rows) <= common and not dealt:
                i, j = np.triu_indices(len(rows), 1)
                good = can_link(n[i], at[i], n[j], at[j], percent)
                pairs.append(np.stack([id[i[good]], id[j[good]]], 1))
                continue
            kind = (np.log(n) / np.log(100 / percent)).astype(np.int64)
            lead, ends = np.zeros(len(rows), bool), np.flatnonzero(np.diff(kind, append=-1)) + 1
            leads = []
            for a, b in zip([0, *ends], ends):
                i = a + int(np.lexsort((id[a:b], rows["shared"][a:b]))[0])
                lead[i] = True
                leads.append(id[i])
                good = can_link(n[a:b], at[a:b], n[i], at[i], percent)
                pairs.append(np.stack([np.full(int(good.sum()), id[i]), id[a:b][good]], 1))
            leads = np.array(leads, np.int64)
            pairs.append(np.stack([leads[:-1], leads[1:]], 1))
            long.append(np.stack([id, np.full(len(id), int(bucket) + int(rows["t"][0])), n, at, kind, lead], 1))
        found = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
        found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], 1), axis=0)
        rows = np.concatenate(long) if long else np.empty((0, 6), np.int64)
        none = np.ones(len(found), bool)
        columns = [np.concatenate([found[:, 0], rows[:, 0]]), *(np.concatenate([np.zeros(len(found), np.int64), rows[:, k]]) for k in range(1, 6))]
        names = ["a", "token", "n", "at", "kind", "lead"]
        empty = np.concatenate([none, np.zeros(len(rows), bool)])
        arrays = [pa.array(columns[0]), pa.array(np.concatenate([found[:, 1], np.zeros(len(rows), np.int64)]), mask=~empty)]
        arrays += [pa.array(c, mask=empty) for c in columns[1:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", *names[1:]])

    return stars


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in parts(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], names=["id", "set"])

    return sets


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    return verify


def linked(docs: DataFrame, table: DataFrame, pairs: DataFrame, n: int, percent: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The pairs (a, b) whose shingle sets link. Outlines sort out most pairs that don't; of the others, and only of
    those, the texts are read and hashed again and the sets compared."""
    a = table.select(F.col("id").alias("a"), F.col("n").alias("x"), F.col("outline").alias("o"))
    b = table.select(F.col("id").alias("b"), F.col("n").alias("y"), F.col("outline").alias("p"))
    pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y", "o", "p").mapInArrow(_outlined(percent), "a long, b long")
    pairs = written(pairs.distinct(), "outlined")
    need = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "need")
    few = need.count() <= broadcast_ids
    sets = docs.join(F.broadcast(need), "id", "left_semi") if few else docs
    sets = sets.select("id", "text").mapInArrow(_sets(n), "id long, set binary")
    sets = written(sets if few else sets.join(need, "id", "left_semi"), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_verify(percent), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge: the least id that edges lead to.

    Every node goes to its least neighbour, and the edges between the nodes that are left are the next level's; a star
    of any size is one level, a path of n nodes about log(n). Levels are written tables."""
    levels, e = [], edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    while not e.isEmpty():
        both = e.select(F.col("a").alias("id"), F.col("b").alias("other")).union(e.select("b", "a"))
        up = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("up")), "level")
        levels.append(up)
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("x")), up.select(F.col("id").alias("b"), F.col("up").alias("y"))
        e = e.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
        e = written(e, "edges")
    if not levels:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = levels[-1].withColumnRenamed("up", "component")
    for up in reversed(levels[:-1]):
        upper = out.select(F.col("id").alias("up"), F.col("component").alias("c"))
        out = written(up.join(upper, "up", "left").select("id", F.coalesce("c", "up").alias("component")), "labels")
    return out


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", common: int = COMMON, kept: int = KEPT, broadcast_ids: int = BROADCAST_IDS, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id), by links of at least ``percent`` Jaccard.

    1. Shingles of all documents are counted; those of many documents come last in the order of the prefix filter.
    2. Documents with equal shingle sets are one class; classes with equal prefixes and size are one group, and its
       least class stands for it in the lists of prefix shingles.
    3. The groups of a short list are paired up. A long list is joined as a star with its most central groups.
       The links make components; of long lists, and of groups with several members, only pairs of different
       components are expanded and verified after that. So large groups of near copies are never paired up, and no
       link that joins two components is missed.

    Null or empty texts have no shingles and no links. Rows that share an id are one node with the links of each.
    Ids are integers; rows without one are left out. An empty table gives an empty one. Other columns are not read."""
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).where("id is not null")
    tokens, counts, bits = common_shingles(rows, n, common, kept)
    shared = rows.sparkSession.sparkContext.broadcast((tokens, counts, bits))
    kinds = "id long, n long, shared long, same1 long, same2 long, group long, prefix binary, outline binary"
    table = written(rows.mapInArrow(_prefixes(n, percent, shared), kinds), "prefixes")
    narrow = table.drop("prefix", "outline")
    full = narrow.where("n > 0")
    classes = written(full.groupBy("n", "same1", "same2").agg(F.min("id").alias("rep"), F.min("group").alias("group")), "classes")
    groups = written(classes.groupBy("n", "group").agg(F.min("rep").alias("lead"), F.count("*").alias("classes")), "groups")
    inside = classes.join(groups.where("classes > 1"), ["n", "group"]).where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    inside = written(inside, "inside")
    edges = linked(rows, table, inside, n, percent, broadcast_ids)
    posted = table.join(groups.select(F.col("lead").alias("id")), "id", "left_semi").select("id", "n", "shared", "prefix")
    shared = rows.sparkSession.sparkContext.broadcast((tokens, posted_rows(posted, shared, list_rows), bits))
    lists = posted.mapInArrow(_postings(percent, shared, list_rows), "bucket long, rows binary")
    stars = "a long, b long, token long, n long, at long, kind long, lead long"
    stars = written(lists.groupBy("bucket").applyInArrow(_stars(percent, common), stars), "stars")
    long = stars.where("token is not null").select(F.col("a").alias("id"), "token", "n", "at", "kind", "lead")
    leads = long.where("lead = 1").select("token", "kind", "id").distinct()
    first = leads.groupBy("token", "kind").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = stars.where("token is null").select("a", "b").union(first.join(leads, ["token", "kind"]).select(F.least("a", "id"), F.greatest("a", "id")).where("a <> id"))
    pairs = written(pairs.toDF("a", "b").distinct(), "pairs")
    edges = written(edges.union(linked(rows, table, pairs, n, percent, broadcast_ids)), "edges")
    known = components(edges)
    member = written(_members(classes, groups, known), "members")
    more = written(_across(long, member, percent).union(_expanded(pairs, groups, member)).distinct().join(pairs.union(inside), ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        known = components(edges.union(linked(rows, table, more, n, percent, broadcast_ids)))
    labels = classes.join(known, classes["rep"] == known["id"], "left").select("n", "same1", "same2", F.coalesce("component", "rep").alias("component_id"))
    out = narrow.join(labels, ["n", "same1", "same2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _members(classes: DataFrame, groups: DataFrame, known: DataFrame) -> DataFrame:
    """(lead, rep, c): the classes of each group with the component that each is in so far."""
    member = classes.join(groups, ["n", "group"]).select("lead", "rep").join(known, F.col("rep") == known["id"], "left")
    return member.select("lead", "rep", F.coalesce("component", "rep").alias("c"))


def _across(long: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists that are of different components: the rows outside a list's main component with the rest.

    A row stands for its whole group. It counts once for each component that the group's members are in, and a pair of
    rows is a pair of all members of the one component with all of the other."""
    of = long.drop("kind", "lead").join(member.select(F.col("lead").alias("id"), "c").distinct(), "id")
    of = written(of, "long")
    main = of.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token")
    main = main.agg(F.max_by("c", "k").alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("token", "main")
    small = of.join(main, "token").where("c <> main").select("token", *(F.col(k).alias(f"{k}2") for k in ("id", "n", "at", "c")))
    both = of.join(small, "token").where("c <> c2 and id <> id2")  # the pairs inside a group are expanded anyway
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    both = both.where((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent))
    one, other = F.struct(F.col("id").alias("lead"), "c"), F.struct(F.col("id2").alias("lead"), F.col("c2").alias("c"))
    both = both.select(F.least(one, other).alias("one"), F.greatest(one, other).alias("other")).distinct()
    both = both.select(F.col("one.lead").alias("a"), F.col("one.c").alias("c"), F.col("other.lead").alias("b"), F.col("other.c").alias("c2"))
    both = both.join(member.toDF("a", "x", "c"), ["a", "c"]).join(member.toDF("b", "y", "c2"), ["b", "c2"])
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _expanded(pairs: DataFrame, groups: DataFrame, member: DataFrame) -> DataFrame:
    """The members of two groups that are a pair, or of one group, that are of different components."""
    several = groups.where("classes > 1").select("lead")
    asked = pairs.join(several, F.col("a") == F.col("lead"), "left_semi").union(pairs.join(several, F.col("b") == F.col("lead"), "left_semi"))
    asked = asked.union(several.select("lead", F.col("lead"))).toDF("a", "b").distinct()
    both = asked.join(member.toDF("a", "x", "c"), "a").join(member.toDF("b", "y", "c2"), "b").where("c <> c2")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
