"""Operator 9 - exact Jaccard self-join of word n-gram sets, as connected components.

Routing (exact): two sets with Jaccard >= t share a token among the first |A| - ceil(t |A|) + 1
tokens of A and of B in any common order. The order is by document frequency, so tokens of one document
come first and join nothing: a document takes part only if at least ceil(t |A|) of its tokens
occur elsewhere, and it goes to the few rarest shared ones. Tokens with the same documents are one
group. (Token, document) pairs travel as packed arrays in two shuffles; a token in more than
``hot`` documents of a batch is replaced by a marker that says so.

Join: in each group, bounds from count vectors propose pairs, parities of finer counts
strike out most that are not links, and the token sets
themselves verify the rest. Round one proposes few pairs, enough to connect a group if they hold, by
direct bounds without a tree (all rows of a small group, else its first rows, against the group); most
links are found here. Round two proposes every pair of the groups that still lies in different components, by
an R-tree over the count vectors (count_tree.py), so no link is lost and copies are not expanded into all
pairs. Groups above ``block`` members are split, in round
two into pairs of parts.

Cases: texts without words (null, empty, blanks) have no tokens and are alone. Fewer than ``k``
words: the whole sequence is the only token. Equal sets are one class from the start (repeated
rows and ids too). A component's id is the smallest non-null id in it (null if all are null).
Texts of any length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (ROW, SPACED, Scratch, id_text, mix, ragged, scan_words, slices, text_buffer, window_hash,
                     with_row_key)
from .components import components
from .count_tree import FINE, GROUPS, CountTree, enough, unlike
from .skew import join_counted

K, PERCENT = 5, 75
HOT = 512                      # documents of a batch that make a token hot there
BLOCK = 4096                   # members of a group in one task
DENSE = 48                     # groups up to this size are compared without a tree
MARK = 0xFFFF
STRETCH = 0xFFFF               # rows whose shingles are sorted at once
PAIRS = 4_000_000              # pairs packed at once


def shingles(data: np.ndarray, off: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct token hashes of all rows, 48 bits each, offsets of each row)."""
    rows = len(off) - 1
    if rows > STRETCH:                       # a row's number and a token share 64 bits
        got = [shingles(data[off[i]:off[min(i + STRETCH, rows)]], off[i:i + STRETCH + 1] - off[i], k)
               for i in range(0, rows, STRETCH)]
        size = np.concatenate([np.diff(at) for _, at in got])
        return np.concatenate([t for t, _ in got]), np.concatenate([[0], np.cumsum(size)])
    first, _, _, h = scan_words(data, off, SPACED)
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, 0)
    token, owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if many.any():
        w = window_hash(h, k)
        token = w[ragged(first[:-1], many)]
        owner = np.repeat(np.arange(rows), many)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([window_hash(h[first[i]:first[i + 1]], int(n[i]))[0] for i in short], np.uint64)
        token, owner = np.concatenate([token, own]), np.concatenate([owner, short])
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (token >> np.uint64(16)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    at = np.searchsorted(key >> np.uint64(48), np.arange(rows + 1, dtype=np.uint64))
    return key & np.uint64((1 << 48) - 1), at


def _heads(src: DataFrame, k: int, percent: int, hot: int, parts: int) -> DataFrame:
    """(row, id, n, s1, s2, point, groups) of every row."""
    kind = src.schema["id"].dataType.simpleString()
    fields = ["bucket", ROW, "id", "n", "s1", "s2", "point", "entries"]
    schema = f"bucket int, {ROW} long, id {kind}, n long, s1 long, s2 long, point binary, entries binary"
    stretch = np.uint64(1 << 12)

    def home(row):                                   # where the entries of a row meet
        return (mix(row.astype(np.uint64) // stretch) % np.uint64(parts)).astype(np.int32)

    def blobs(bucket, base, data, t):
        m = len(bucket)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(base, pa.int64()), pa.nulls(m, t), *(pa.nulls(m, pa.int64()),) * 3,
             pa.nulls(m, pa.binary()), pa.array(data, pa.binary())], names=fields)

    def entries(row, key):
        """Blobs of (row, key) by home; rows as offsets from the blob's first."""
        to = home(row)
        o = np.argsort(to, kind="stable")
        row, key, to = row[o], key[o], to[o]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        out = ([], [], [])
        for lo, hi in zip(at, np.append(at[1:], len(to))):
            # rows of one task are close; a blob never spans more than 2^32 of them
            for task in np.unique(row[lo:hi] >> 32):
                m = np.flatnonzero(row[lo:hi] >> 32 == task) + lo
                base = int(row[m].min())
                out[0].append(int(to[lo]))
                out[1].append(base)
                out[2].append((row[m] - base).astype("<u4").tobytes() + key[m].astype("<u8").tobytes())
        return out

    def pack(batches):
        seen: set[tuple] = set()
        for whole in batches:
            t = whole.schema.field("id").type
            held, size, base, rows = [], 0, None, 0

            def flush():
                nonlocal held, size, base
                if not held:
                    return
                key = np.sort(np.concatenate(held))
                token = key >> np.uint64(16)
                at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                count = np.diff(np.append(at, len(key)))
                often = count > hot
                if often.any():
                    m = np.repeat(often, count)
                    row = base + (key[m] & np.uint64(MARK)).astype(np.int64)
                    yield blobs(*entries(row, _hot_key(token[m])), t)
                    key = np.sort(np.concatenate([key[~m], (token[at[often]] << np.uint64(16)) | np.uint64(MARK)]))
                    token = key >> np.uint64(16)
                bucket = ((token >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                # a negative bucket: pairs still to be counted
                yield blobs([-1 - int(b) for b in bucket[at]], [base] * len(at),
                            [key[lo:hi].astype("<u8").tobytes() for lo, hi in zip(at, np.append(at[1:], len(key)))], t)
                held, size, base = [], 0, None

            for b in slices(whole):
                token, at = shingles(*text_buffer(b.column("text")), k)
                n, row = np.diff(at), np.asarray(b.column(ROW), np.int64)
                full = n > 0
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                point, fine = np.zeros((len(n), GROUPS), np.int32), np.zeros((len(n), FINE // 8), np.uint8)
                if full.any():
                    s1[full] = np.add.reduceat(mix(token), at[:-1][full])
                    s2[full] = np.add.reduceat(mix(token ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
                    cell = (mix(token) % np.uint64(FINE)).astype(np.int64)
                    for lo in range(0, len(n), 512):                    # rows at once: their cells fit in memory
                        hi = min(lo + 512, len(n))
                        owner = np.repeat(np.arange(hi - lo), n[lo:hi])
                        count = np.bincount(owner * FINE + cell[at[lo]:at[hi]],
                                            minlength=(hi - lo) * FINE).reshape(-1, FINE)
                        fine[lo:hi] = np.packbits((count & 1).astype(np.uint8), axis=1)
                        point[lo:hi] = count.reshape(hi - lo, GROUPS, -1).sum(axis=2)
                s1, s2 = s1.view(np.int64), s2.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home(row)), b.column(ROW), b.column("id"), pa.array(n), pa.array(s1), pa.array(s2),
                     pa.array([p.astype("<i4").tobytes() + f.tobytes() for p, f in zip(point, fine)], pa.binary()),
                     pa.nulls(len(n), pa.binary())], names=fields)
                for i, sign in enumerate(zip(n.tolist(), s1.tolist(), s2.tolist())):
                    if not sign[0] or sign in seen:
                        continue
                    if len(seen) < 1 << 18:
                        seen.add(sign)
                    r = int(row[i])
                    if base is not None and (size > PAIRS or not 0 <= r - base < MARK):
                        yield from flush()
                    base = r if base is None else base
                    own = token[at[i]:at[i + 1]]
                    held.append((own << np.uint64(16)) | np.uint64(r - base))
                    size += len(own)
            yield from flush()

    def _hot_key(token):
        return np.uint64(255 << 56) | (mix(token) >> np.uint64(8))

    def count(batches):
        """Pairs of a bucket to entries (row, order key: 8 bits of frequency, 56 of the group)."""
        held, bucket, t = [], None, None

        def flush():
            if not held:
                return
            key = np.concatenate([np.frombuffer(d, "<u8") for _, d in held])
            row = np.repeat(np.array([r for r, _ in held]), [len(d) // 8 for _, d in held])
            o = np.argsort(key, kind="stable")
            key, row = key[o], row[o] + (key[o] & np.uint64(MARK)).astype(np.int64)
            token, mark = key >> np.uint64(16), (key & np.uint64(MARK)) == MARK
            at = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            n = np.diff(np.append(at, len(key)))
            shared = n > 1
            hot_one = np.maximum.reduceat(mark, at)
            group = mix(np.add.reduceat(mix(row.astype(np.uint64)), at))         # of the documents of a token
            order = np.minimum(n, 254).astype(np.uint64) << np.uint64(56) | group >> np.uint64(8)
            order = np.where(hot_one, _hot_key(token[at]), order)
            keep = np.repeat(shared | hot_one, n) & ~mark
            if keep.any():
                yield blobs(*entries(row[keep], np.repeat(order, n)[keep]), t)

        for b in batches:
            t = b.schema.field("id").type
            done = np.asarray(b.column("bucket")) >= 0
            if done.any():
                yield b.filter(pa.array(done))
            for i in np.flatnonzero(~done).tolist():
                own = b.column("bucket")[i].as_py()
                if own != bucket:
                    yield from flush()
                    held, bucket = [], own
                held.append((b.column(ROW)[i].as_py(), b.column("entries")[i].as_py()))
        yield from flush()

    def choose(batches):
        """The groups of every row: its rarest shared tokens, as many as the threshold asks for."""
        heads, held = [], []
        names = [ROW, "id", "n", "s1", "s2", "point", "groups"]
        bucket = None

        def flush():
            if not heads:
                return
            head = pa.Table.from_batches(heads).combine_chunks()
            own = np.asarray(head.column(ROW), np.int64)
            row, key = np.empty(0, np.int64), np.empty(0, np.uint64)
            if held:
                m = [len(d) // 12 for _, d in held]
                row = np.concatenate([r + np.frombuffer(d, "<u4", c).astype(np.int64) for (r, d), c in zip(held, m)])
                key = np.concatenate([np.frombuffer(d, "<u8", c, 4 * c) for (_, d), c in zip(held, m)])
            o = np.lexsort((key, row))
            row, key = row[o], key[o]
            lo, hi = np.searchsorted(row, own, "left"), np.searchsorted(row, own, "right")
            need = -(-percent * np.asarray(head.column("n"), np.int64) // 100)
            take = np.where(hi > lo, np.maximum(hi - lo - need + 1, 0), 0)
            groups = [np.unique(key[a:a + c]).view(np.int64) for a, c in zip(lo.tolist(), take.tolist())]
            out = pa.array(groups, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(head.column(c).combine_chunks() if head.num_rows else head.column(c) for c in names[:-1]), out],
                names=names)

        for b in batches:
            to = np.asarray(b.column("bucket"))
            for v in np.unique(to).tolist():
                if v != bucket:
                    yield from flush()
                    heads, held, bucket = [], [], v
                part = b.filter(pa.array(to == v))
                blob = part.column("entries").is_valid()
                heads.append(part.filter(pa.compute.invert(blob)))
                part = part.filter(blob)
                held += zip(part.column(ROW).to_pylist(), part.column("entries").to_pylist())
        yield from flush()

    def dealt(df):
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    out = dealt(dealt(src.mapInArrow(pack, schema)).mapInArrow(count, schema))
    return out.mapInArrow(choose, f"{ROW} long, id {kind}, n long, s1 long, s2 long, point binary, groups array<long>")


def _pairs(members: DataFrame, percent: int, final: bool) -> DataFrame:
    """Pairs (a, b) that the count vectors allow, from members (g, salt, row, n, point, c, side).

    Not final: few pairs of each group, a forest. Final: every pair whose components c differ;
    ``side`` is 0, or 1 and 2 for the two parts of a split group.
    """
    def allowed(i, j, n, fine):
        """Of the indexes j, those that the parities allow as well."""
        return j[enough((n[j] + n[i] - unlike(fine[j], fine[i])) // 2, n[j], n[i], percent)]

    def forest(row, n, x, fine, join):
        out, m = [], len(row)
        if m <= DENSE:
            pick = np.arange(m)
        else:
            pick = np.arange(6)                                 # the first rows, as in the other groups they are in
        for i in pick.tolist():
            ok = enough(np.minimum(x, x[i]).sum(axis=1), n, n[i], percent)
            for j in allowed(i, np.flatnonzero(ok), n, fine).tolist():
                if j != i and join(int(row[i]), int(row[j])):
                    out.append((int(min(row[i], row[j])), int(max(row[i], row[j]))))
        return out

    def crossing(row, n, x, fine, c, side, seen):
        kinds, label = np.unique(c, return_inverse=True)
        if len(kinds) < 2:
            return []
        out, tree = [], CountTree(x, n, percent)
        most = np.bincount(label).argmax()
        for i in np.flatnonzero(label != most).tolist():       # every crossing pair has a member here
            j = tree.near(x[i], int(n[i]))
            j = j[(label[j] != label[i]) & ((side[j] == 0) | (side[j] != side[i]))
                  & ((label[j] == most) | (j > i))]
            for r in row[allowed(i, j, n, fine)].tolist():
                pair = (min(int(row[i]), r), max(int(row[i]), r))
                if pair not in seen:                            # a pair meets in several groups
                    seen.add(pair)
                    out.append(pair)
        return out

    def run(batches):
        parent: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()

        def find(v):
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        def join(a, b):
            a, b = find(a), find(b)
            parent[a] = b
            return a != b

        last, held = None, []

        def solve():
            held.sort()                                         # by row: tasks choose the same pairs
            row, n, point, c, side = zip(*held)
            row, n, c, side = np.array(row), np.array(n), np.array(c), np.array(side)
            raw = np.frombuffer(b"".join(point), np.uint8).reshape(len(row), -1)
            x = np.ascontiguousarray(raw[:, :4 * GROUPS]).view("<i4")
            fine = np.ascontiguousarray(raw[:, 4 * GROUPS:]).view("<u8")
            got = crossing(row, n, x, fine, c, side, seen) if final else forest(row, n, x, fine, join)
            if got:
                a, b = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            for g, salt, *rest in zip(*(b.column(k).to_pylist() for k in ("g", "salt", ROW, "n", "point", "c", "side"))):
                if (g, salt) != last:
                    if len(held) > 1:
                        yield from solve()
                    held, last = [], (g, salt)
                    if len(parent) > 1 << 18:                   # only saves work: pairs are made distinct later
                        parent.clear()
                    if len(seen) > 1 << 18:
                        seen.clear()
                held.append(rest)
        if len(held) > 1:
            yield from solve()

    return (members.repartition("g", "salt").sortWithinPartitions("g", "salt").mapInArrow(run, "a long, b long")
            .distinct())


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose token sets reach the threshold."""
    a = sets.select(F.col(ROW).alias("a"), F.col("tokens").alias("ta"))
    b = sets.select(F.col(ROW).alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").filter(
        (100 + percent) * both >= percent * (F.size("ta") + F.size("tb"))).select("a", "b")


def _sets(text: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for b in slices(whole):
                token, at = shingles(*text_buffer(b.column("text")), k)
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(ROW), values], names=[ROW, "tokens"])

    # by shuffle at every size: the rows grow with the table
    return text.join(rows.hint("merge"), ROW, "left_semi").select(ROW, "text").mapInArrow(
        run, f"{ROW} long, tokens array<long>")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                       percent: int = PERCENT, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: row key, id, n_shingles, component_id, first (the first row, by key, of
    those with the component's id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    keyed = with_row_key(docs)
    text = keyed.select(ROW, F.col(f"`{text_col}`").cast("string").alias("text"))
    src = id_text(keyed, id_col, text_col)
    src = keyed.select(ROW, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = scratch.save(_heads(src, k, percent, hot, parts), "heads")
    classes = heads.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min(ROW).alias("rep"))
    own = scratch.save(heads.join(classes, ["n", "s1", "s2"], "left").select(
        ROW, "id", "n", F.coalesce("rep", ROW).alias("rep")), "classes")
    spread = (heads.join(classes.select(F.col("rep").alias(ROW)), ROW, "left_semi")
              .select(F.explode("groups").alias("g"), ROW, "n", "point"))
    sizes = spread.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("m") / block).cast("int")), "sizes")
    members = scratch.save(join_counted(spread, sizes, ["g"], "m", F.xxhash64(ROW))
                           .withColumn("salt", F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int")), "members")
    scratch.drop("heads", "sizes")
    one = members.select("g", "salt", ROW, "n", "point", F.lit(0).cast("long").alias("c"), F.lit(0).alias("side"))
    pairs = scratch.save(_pairs(one, percent, False), "pairs")
    # for both rounds at once: a second pass over the texts would cost more than the sets of rows without a pair
    sets = scratch.save(_sets(text, members.select(ROW).distinct(), k), "sets")
    links = scratch.save(_linked(pairs, sets, percent), "links")
    now = components(links, scratch, "one")
    labelled = members.join(now.withColumnRenamed("v", ROW), ROW, "left").withColumn("c", F.coalesce("c", ROW))
    split = labelled.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("g")
    labelled = labelled.join(split, "g", "left_semi")
    # parts of a split group meet in pairs (i <= j)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    two = labelled.select("g", "salt", "parts", ROW, "n", "point", "c", other).select(
        "g", (F.least("salt", "other") * F.col("parts") + F.greatest("salt", "other")).alias("salt"), ROW, "n", "point",
        "c", F.when(F.col("salt") == F.col("other"), 0).when(F.col("salt") < F.col("other"), 1).otherwise(2).alias("side"))
    pairs = scratch.save(_pairs(two, percent, True), "pairs2")
    more = scratch.save(_linked(pairs, sets, percent), "links2")
    if more.limit(1).count():
        now = components(links.unionByName(more), scratch, "two")
    scratch.drop("sets", "members", "pairs", "pairs2")
    # names of components by classes of equal sets, then back to the rows
    named = own.groupBy("rep").agg(F.count("*").alias("copies"), F.min("id").alias("id"),
                                   F.min(F.struct(F.col("id").isNull(), "id", ROW)).alias("_first"))
    named = scratch.save(named.join(now.withColumnRenamed("v", "rep"), "rep", "left")
                         .withColumn("label", F.coalesce("c", "rep")).drop("c"), "named")
    whole = named.groupBy("label").agg(F.count("*").alias("m"), F.min("id").alias("component_id"),
                                       F.min("_first").alias("_first"))
    named = join_counted(named.select("rep", "copies", "label"), scratch.save(whole, "components"), ["label"], "m",
                         F.xxhash64("rep"))
    named = scratch.save(named.select("rep", "copies", "component_id", "_first"), "names")
    return join_counted(own, named, ["rep"], "copies", F.xxhash64(ROW)).select(
        ROW, F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col(f"_first.{ROW}").alias("first"))
