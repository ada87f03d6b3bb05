"""Exact Jaccard self-join of word-shingle sets by vertical partitioning.

The global order of shingles (their 64-bit hashes) is cut into fragments.  A task
holds one fragment of many documents, counts partial overlaps there, and sums over
the fragments give the overlap of a pair.  What keeps the work in proportion:

* documents with equal sets form one class before anything is compared;
* half of the hash space is indexed first; a class stays only if so many of its
  indexed shingles occur in other classes as a link at the threshold implies;
* links need a common shingle among the rarest ``n - ceil(t n) + 1`` of both sides.
  Stars around a pivot of each such shingle give the first pairs, which are verified
  and contracted to components: a group of near copies is mostly one from here on;
* only shingles that several components hold matter after that.  They tie the classes
  into clusters between which no link is possible.  Small clusters are packed into
  parts; a large one is cut into blocks, and every two blocks form a group, so that
  tasks follow the pairs that are looked at and no cluster fills one;
* of pairs between different components, only those whose segments reach the threshold
  in at least one fragment are summed: if all partial overlaps were below it, so would
  be their sum.  A first round takes the closest of these for each component and
  contracts again; the last takes all that remain, so no pair that could join two
  components is left out.

Hashes of shingles and sets are 64 bits wide: a pair of unequal sets is taken for
equal with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import BROADCAST_BYTES, cut, discard, lean_groups, map_batches, small_side
from .components import connected
from .tokens import mix64, shingle_hashes, slices, word_hashes

_U = np.uint64
#: Postings gathered by a map task before it sends them, and postings meant for a fragment.
FLUSH, FRAGMENT = 500_000, 1_000_000
#: Fragments of the pair stage, and shingles of one block of a cluster.
VERTICAL, BLOCK = 2, 100_000
#: Pairs that a task looks at at a time.
PAIRS = 1_000_000
#: Pairs of one class that are verified in one task.
HUB = 500


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, ascending, and per row the index of its first."""
    s, rows = shingle_hashes(*word_hashes(data, offs), k)
    for i in range(len(rows) - 1):
        s[rows[i] : rows[i + 1]].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[rows[:-1][np.diff(rows) > 0]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def _set_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(s ^ _U(0x5851F42D4C957F2D)), dtype=_U)])
    return mix64((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(_U) * _U(0x9FB21C651E98DF25)).view(np.int64)


def _indexed(s: np.ndarray) -> np.ndarray:
    return (s & _U(1)) == 0


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _fragment(s: np.ndarray, parts: int) -> np.ndarray:
    return ((s >> _U(32)) * _U(parts)) >> _U(32)


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x by significance: the high ones are zeros that compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _profile(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, indexed, cid): size of the set, how many of it are indexed, id of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offs in slices(b.column(1)):
                s, at = shingle_sets(data, offs, k)
                half = np.concatenate([[0], np.cumsum(_indexed(s))])
                yield pa.record_batch([b.column(0).slice(row, len(at) - 1), pa.array(np.diff(at)), pa.array(half[at[1:]] - half[at[:-1]]), pa.array(_set_ids(s, at))], names=["doc_id", "n", "indexed", "cid"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, run, f"doc_id {kind}, n long, indexed long, cid long")


_POSTINGS = "frag int, n long, toks binary, rows binary, cids binary, needs binary"


def _postings(docs: DataFrame, k: int, percent: int, parts: int) -> DataFrame:
    """Per fragment and flush: indexed shingles (high 48 bits as gaps) with the classes that hold them."""

    def send(toks: list, rows: list, cids: list, needs: list) -> pa.RecordBatch:
        tok, row = np.concatenate(toks), np.concatenate(rows)
        cid, need = np.concatenate(cids), np.concatenate(needs)
        order = np.argsort(tok, kind="stable")
        tok, row = tok[order], row[order]
        edge = np.searchsorted(_fragment(tok, parts), np.arange(parts + 1, dtype=_U))
        out: list[list] = [[] for _ in range(6)]
        for f in range(parts):
            part, who = tok[edge[f] : edge[f + 1]] >> _U(16), row[edge[f] : edge[f + 1]]
            used, local = np.unique(who, return_inverse=True)
            if f == 0:  # classes that stay whatever their indexed shingles say are named here
                used = np.concatenate([used, np.setdiff1d(np.flatnonzero(need <= 0), used)])
            if not len(used):
                continue
            gaps = np.diff(part, prepend=_U(0))
            for col, value in zip(out, (f, len(part), _planes(gaps), _planes(local.astype(np.uint32)), cid[used].tobytes(), need[used].astype(np.int32).tobytes()), strict=True):
                col.append(value)
        return pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["frag", "n", "toks", "rows", "cids", "needs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        docs_held = size = 0
        for b in batches:
            for _, data, offs in slices(b.column(0)):
                s, at = shingle_sets(data, offs, k)
                n = np.diff(at)
                mask = _indexed(s)
                row = np.repeat(np.arange(len(n)), n)[mask]
                need = np.bincount(row, minlength=len(n)) - (n - _least_overlap(n, percent))
                need[n == 0] = 1  # an empty set links with nothing
                for x, value in zip(held, (s[mask], row + docs_held, _set_ids(s, at), need), strict=True):
                    x.append(value)
                docs_held += len(n)
                size += len(row)
                if size >= FLUSH:
                    yield send(*held)
                    held, docs_held, size = ([], [], [], []), 0, 0
        if docs_held:
            yield send(*held)

    return map_batches(docs.select("text"), run, _POSTINGS)


def _count_shared(t: pa.Table) -> pa.Table:
    toks, rows, cids, needs, base = [], [], [], [], 0
    for _, n, tok, row, cid, need in zip(*(t.column(c).to_pylist() for c in ("frag", "n", "toks", "rows", "cids", "needs")), strict=True):
        if n:
            toks.append(np.cumsum(_unplanes(tok, _U), dtype=_U))
            rows.append(_unplanes(row, np.uint32).astype(np.int64) + base)
        cids.append(np.frombuffer(cid, np.int64))
        needs.append(np.frombuffer(need, np.int32))
        base += len(cids[-1])
    cid, first, which = np.unique(np.concatenate(cids), return_index=True, return_inverse=True)
    need = np.concatenate(needs)[first].astype(np.int64)
    shared = np.zeros(len(cid), np.int64)
    if toks:
        tok, who = np.concatenate(toks), which[np.concatenate(rows)]
        order = np.argsort(tok, kind="stable")
        tok, who = tok[order], who[order]
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        sizes = np.diff(np.append(starts, len(tok)))
        many = np.repeat(sizes > 1, sizes)  # only these can be held by several classes
        tok, who = tok[many], who[many]
        order = np.lexsort((who, tok))
        tok, who = tok[order], who[order]
        fresh = np.ones(len(tok), bool)
        fresh[1:] = (tok[1:] != tok[:-1]) | (who[1:] != who[:-1])
        tok, who = tok[fresh], who[fresh]
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(tok)))
        shared = np.bincount(who[np.repeat(sizes > 1, sizes)], minlength=len(cid))
    keep = (shared > 0) | (need <= 0)
    cid, shared, need = cid[keep], shared[keep].astype(np.int64), need[keep]
    # packed by buckets of classes: a class is counted in many fragments, but costs no row in each
    bucket = cid.view(_U) % _U(t.column("buckets")[0].as_py())
    order = np.argsort(bucket, kind="stable")
    own, starts = np.unique(bucket[order], return_index=True)
    parts = [[x.tobytes() for x in np.split(v[order], starts[1:])] if len(own) else [] for v in (cid, shared, need)]
    return pa.table([pa.array(own.astype(np.int32)), *(pa.array(x, pa.binary()) for x in parts)], names=["bucket", "cids", "shared", "needs"])


def _alive(t: pa.Table) -> pa.Table:
    """The classes of a bucket with as many shared shingles over all fragments as a link implies."""
    cid, shared, need = (np.concatenate([np.frombuffer(x, np.int64) for x in t.column(c).to_pylist()]) for c in ("cids", "shared", "needs"))
    own, first, which = np.unique(cid, return_index=True, return_inverse=True)
    total = np.bincount(which.reshape(-1), shared, minlength=len(own))
    return pa.table({"cid": own[total >= need[first]]})


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(cid, n, toks): the shingles of each row's set, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offs in slices(b.column(0)):
                s, at = shingle_sets(data, offs, k)
                toks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.record_batch([pa.array(_set_ids(s, at)), pa.array(np.diff(at)), toks], names=["cid", "n", "toks"])

    return map_batches(docs.select("text"), run, "cid long, n long, toks array<long>")


def _pieces(sets: DataFrame) -> DataFrame:
    """(cid, n, frag, seg): each set (toks) cut by the ranges of the global order."""
    frag = F.explode(F.sequence(F.lit(0), F.lit(VERTICAL - 1))).alias("frag")
    inside = F.filter("toks", lambda x: F.shiftright(F.shiftrightunsigned(x, 33) * VERTICAL, 31) == F.col("frag"))
    return sets.select("cid", "n", "toks", frag).select("cid", "n", "frag", inside.alias("seg"))


class _Fragment:
    """The entries (shingle, class) of one fragment of a part, by class and then by shingle."""

    def __init__(self, t: pa.Table) -> None:
        self.cid, self.n, self.comp = (t.column(c).to_numpy() for c in ("cid", "n", "comp"))
        segs = t.column("seg").combine_chunks()
        at = segs.offsets.to_numpy().astype(np.int64)
        tok = segs.values.to_numpy()[at[0] : at[-1]].view(_U) if len(at) else np.zeros(0, _U)
        self.sizes, self.begin = np.diff(at), at - at[:1]
        who = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.own = np.unique(tok, return_inverse=True)[1].reshape(-1)
        self.width = int(self.own.max(initial=0)) + 1
        self.codes = who * self.width + self.own
        df = np.bincount(self.own, minlength=1)[self.own]
        # the rarest shingles of each segment that a partner at the threshold must share
        self.by_rarity = np.lexsort((self.own, df, who))
        self.who, self.df = who, df

    def prefix(self, percent: int, side: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shingle, class and place of all segments' prefixes that other segments hold too, by shingle and side."""
        o = self.by_rarity
        place = np.arange(len(o)) - np.repeat(self.begin[:-1], self.sizes)
        allowed = np.repeat(self.sizes - _least_overlap(self.sizes, percent) + 1, self.sizes)
        keep = (place < allowed) & (self.df[o] > 1)
        o, place = o[keep], place[keep]
        by = np.lexsort((side[self.who[o]], self.own[o]))
        return self.own[o][by], self.who[o][by], place[by]

    def overlaps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common shingles of the segments of x and y, pair by pair."""
        out = np.zeros(len(x), np.int64)
        step = max(1, PAIRS // max(1, int(self.sizes.max(initial=1))))
        for at in range(0, len(x), step):
            a, b = x[at : at + step], y[at : at + step]
            n = self.sizes[a]
            pair = np.repeat(np.arange(len(a)), n)
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[a], n)
            want = b[pair] * self.width + self.own[pos]
            hit = self.codes[np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)] == want
            out[at : at + step] = np.bincount(pair[hit], minlength=len(a))
        return out


def _close_pairs(percent: int, full: bool):
    """Pairs of classes of different components whose segments reach the threshold in this fragment:
    all of them, or the closest of each component.

    A group holds one block of a part, or two of them (sides 0 and 1), between which pairs are formed.
    """

    def run(t: pa.Table) -> pa.Table:
        f = _Fragment(t)
        side, m = t.column("side").to_numpy(), max(1, len(f.cid))
        rank, who, place = f.prefix(percent, side)
        edge = np.flatnonzero(np.concatenate([rank[1:] != rank[:-1], [True]])) + 1 if len(rank) else np.zeros(0, np.int64)
        to = np.repeat(edge, np.diff(edge, prepend=0))  # where the list of each entry ends
        since = np.arange(len(rank)) + 1
        if side.any():
            both = side[who]
            since = np.repeat(edge - np.add.reduceat(both, edge - np.diff(edge, prepend=0)), np.diff(edge, prepend=0)) if len(edge) else since
            since = np.where(both == 0, since, to)
        many = np.maximum(0, to - since)
        ends = np.cumsum(many)
        kept = [np.zeros(0, np.int64)]
        at = 0
        while at < len(many):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            e = np.repeat(np.arange(at, last), many[at:last])
            o = np.arange(len(e)) - np.repeat(ends[at:last] - many[at:last] - (ends[at - 1] if at else 0), many[at:last]) + since[e]
            a, b = who[e], who[o]
            # sizes and places in the order bound what two segments can have in common
            x, y = f.sizes[a], f.sizes[b]
            most = np.minimum(x - place[e], y - place[o])
            ok = (f.comp[a] != f.comp[b]) & (100 * np.minimum(f.n[a], f.n[b]) >= percent * np.maximum(f.n[a], f.n[b])) & (100 * most >= percent * (x + y - most))
            codes = np.unique(np.minimum(a[ok], b[ok]) * m + np.maximum(a[ok], b[ok]))
            a, b = codes // m, codes % m
            common = f.overlaps(a, b)
            kept.append(codes[100 * common >= percent * (f.sizes[a] + f.sizes[b] - common)])
            at = last
        codes = np.unique(np.concatenate(kept))
        if not full and len(codes):
            a, b = codes // m, codes % m
            common = f.overlaps(a, b)
            share = common / (f.sizes[a] + f.sizes[b] - common)
            comp, pair = np.concatenate([f.comp[a], f.comp[b]]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((pair, -share[pair], comp))
            first = np.concatenate([[True], comp[order][1:] != comp[order][:-1]])
            codes = codes[np.unique(pair[order[first]])]
        a, b = f.cid[codes // m], f.cid[codes % m]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _verified(pairs: DataFrame, pieces: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a table whose partial overlaps, counted fragment by fragment, sum up to the threshold.

    Every pair is a group of its own, so no class with many pairs meets in one task.  Its
    pieces come to it by broadcast pairs, or, where these are too many, by a join that
    deals the pairs of a class with more than ``HUB`` of them to several tasks.
    """
    ends = pairs.select(F.col("a").alias("cid"), "a", "b").union(pairs.select(F.col("b").alias("cid"), "a", "b"))
    if pairs.count() * 48 <= BROADCAST_BYTES:
        met = pieces.join(F.broadcast(ends), "cid")
    else:
        hubs = ends.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts"))
        dealt = ends.join(hubs, "cid").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts")).cast("int")).drop("salts")
        met = pieces.join(hubs, "cid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(dealt, ["cid", "salt"])
    both = met.groupBy("a", "b").agg(F.collect_list(F.when(F.col("cid") == F.col("a"), F.struct("frag", "n", "seg"))).alias("x"), F.collect_list(F.when(F.col("cid") == F.col("b"), F.struct("frag", "n", "seg"))).alias("y"))
    other = lambda x: F.filter("y", lambda y: y["frag"] == x["frag"])[0]["seg"]
    common = F.aggregate("x", F.lit(0), lambda n, x: n + F.size(F.array_intersect(x["seg"], other(x))))
    sums = both.select("a", "b", common.alias("common"), (F.col("x")[0]["n"] + F.col("y")[0]["n"]).alias("n"))
    return sums.filter(100 * F.col("common") >= percent * (F.col("n") - F.col("common"))).select("a", "b")


def _by_id(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is listed; null-safe; broadcast only when counted to be small."""
    side = ids.select(F.col("doc_id").alias("__wl_id")).distinct()
    return docs.join(small_side(side, 16), docs["doc_id"].eqNullSafe(F.col("__wl_id")), "left_semi")


def classes(docs: DataFrame, k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(profile of every row, (node, root) of all classes that have links)."""
    profile = cut(_profile(docs, k, percent), "profile")
    total = profile.agg(F.coalesce(F.sum("indexed"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // FRAGMENT))
    postings = _postings(docs, k, percent, parts).withColumn("buckets", F.lit(parts))
    shared = postings.groupBy("frag").applyInArrow(lean_groups(_count_shared), "bucket int, cids binary, shared binary, needs binary")
    alive = shared.groupBy("bucket").applyInArrow(lean_groups(_alive), "cid long")
    sizes = profile.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    alive = cut(sizes.join(alive, "cid"), "alive")
    own = _sets(_by_id(docs, alive), k)
    sets = cut(own.join(alive.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]).select("cid", "n", "toks"), "sets")

    # the prefix of each set: its rarest shingles, of which only those held elsewhere matter
    tokens = sets.select("cid", "n", F.explode("toks").alias("tok"))
    common = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rare = Window.partitionBy("cid").orderBy("df", "tok")
    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    place = F.row_number().over(rare) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("cid")) - 1
    prefix = tokens.join(common, "tok").withColumn("place", place).filter(F.col("place") < need).select("cid", "n", "tok", "place")
    prefix = cut(prefix, "prefix")
    # two pivots of each shingle: one that its neighbours mostly share, for some shingles one at random
    mixed, whole = F.xxhash64("cid", "tok"), F.struct("cid", "n", "place")
    pivots = prefix.groupBy("tok").agg(F.min(whole).alias("p"), F.max_by(whole, mixed).alias("q"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    both = F.when(F.pmod("tok", F.lit(16)) == 0, F.array("p", "q")).otherwise(F.array("p"))
    most = F.least(F.col("n") - F.col("place"), F.col("p.n") - F.col("p.place"))
    fit = (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (100 * most >= percent * (F.col("n") + F.col("p.n") - most))
    stars = prefix.join(pivots.select("tok", F.explode(both).alias("p")), "tok").filter((F.col("cid") != F.col("p.cid")) & fit)
    stars = cut(stars.select(F.least("cid", "p.cid").alias("a"), F.greatest("cid", "p.cid").alias("b")).distinct(), "stars")

    # ids with several rows tie the classes of these rows together
    least = profile.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a <> z").select("doc_id", "a")
    links = profile.filter("n > 0").join(small_side(cut(least, "twice"), 24), "doc_id").filter("a <> cid").select("a", F.col("cid").alias("b"))
    pieces = cut(_pieces(sets), "pieces")
    roots = connected(_verified(stars, pieces, percent).union(links))
    for last in (False, True):
        known = prefix.join(small_side(roots, 16), prefix["cid"] == roots["node"], "left").select("cid", "tok", F.coalesce("root", "cid").alias("comp"))
        pairs = cut(_open_pairs(known, sets.select("cid", "n"), pieces, percent, last), "pairs")
        found = _verified(pairs, pieces, percent)
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
        discard(pairs)
    discard(alive, sets, prefix, stars, pieces)
    return profile, roots


def _open_pairs(known: DataFrame, sizes: DataFrame, pieces: DataFrame, percent: int, full: bool) -> DataFrame:
    """Close pairs (a, b) of different components, given the prefixes of all classes (cid, tok, comp)."""
    # shingles that classes of several components hold, and the clusters that these tie together
    mixed = known.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("cid").alias("p")).filter("x <> y").select("tok", "p")
    ties = cut(known.join(mixed, "tok").select(F.col("cid").alias("a"), F.col("p").alias("b"), "comp"), "ties")
    clusters = connected(ties)
    state = sizes.join(small_side(clusters, 16), sizes["cid"] == clusters["node"]).select("cid", "n", F.col("root").alias("cluster"))
    state = cut(state.join(small_side(ties.select(F.col("a").alias("cid"), "comp").distinct(), 16), "cid"), "state")

    # small clusters are packed into parts; of a large one, every two blocks form a group of their own
    size = state.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.sum("n").alias("size"))
    size = cut(size, "sizes")
    room = size.filter("blocks = 1").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    part = F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-room // BLOCK)))))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = state.join(small_side(size, 20), "cluster").select("cid", "comp", "blocks", part.alias("part"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cid", "comp", "blocks", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    close = pieces.join(dealt, "cid").groupBy("blocks", "part", "i", "j", "frag").applyInArrow(lean_groups(_close_pairs(percent, full)), "a long, b long")
    return close.distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_size.

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of
    ``k``-word shingles (fewer words: the whole sequence as one).  component_id is
    the smallest id reachable by links.  Rows without words, null and empty texts
    have an empty set and are alone; rows that share an id belong together; a row
    with a null id takes the smallest id it links with, or null.  class_size counts
    the rows with an equal set.  An empty table gives no rows.
    """
    profile, roots = classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), k, percent)
    rows = profile.join(roots, profile["cid"] == roots["node"], "left").select("doc_id", "n", "cid", F.coalesce("root", "cid").alias("g"))
    full = rows.filter("n > 0")
    sizes = full.groupBy("cid").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1").withColumnRenamed("cid", "__wl_c")
    groups = full.groupBy("g").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1").select(F.col("g").alias("__wl_g"), "least")
    out = rows.join(groups, (F.col("g") == F.col("__wl_g")) & (F.col("n") > 0), "left").join(sizes, (F.col("cid") == F.col("__wl_c")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows of a component that are not of its smallest id; one row of that id stays.

    Rows with an empty set all stay, and so do rows with a null id, which nothing could name.
    """
    comp = jaccard_components(docs, k, percent, doc_id, text).select(F.col("doc_id").alias("__wl_id"), F.col("n_shingles").alias("__wl_n"), F.col("component_id").alias("__wl_c"))
    comp = cut(comp, "groups")
    go = comp.filter((F.col("__wl_n") > 0) & (F.col("__wl_id") != F.col("__wl_c"))).select("__wl_id").distinct()
    stay = docs.join(small_side(go, 16), docs[doc_id] == go["__wl_id"], "left_anti")
    again = comp.filter("__wl_n > 0 and __wl_id is not null").groupBy("__wl_id").count().filter("count > 1").select("__wl_id")
    if again.isEmpty():
        return stay
    again = small_side(again, 16)
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    several = stay.filter(~blank).join(again, stay[doc_id] == again["__wl_id"], "left_semi").dropDuplicates([doc_id])
    single = stay.filter(~blank).join(again, stay[doc_id] == again["__wl_id"], "left_anti")
    return single.unionByName(several).unionByName(stay.filter(blank))
