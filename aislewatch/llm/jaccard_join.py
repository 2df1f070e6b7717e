"""N-gram Jaccard join with a token-group matrix.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets are one class. What
two classes of a Jaccard similarity of 0.8 share must show early in any order of the tokens that all classes use: k of
their common tokens are among the first n - ceil(0.8 n) + k of each (here k = n / 20, tokens by their numbers of sets,
rare ones first). Only classes of which so many first tokens are shared ("live" ones) go on. They are packed into groups
of similar classes, of a few hundred each; links inside a group are found by multiplying its rows. The matrix says which
token lies in which group's union; a class opens another group only if enough of its first tokens lead there, sizes fit,
and its overlap with the union can reach 0.8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewatch.llm.common import components, content, cut, scratch, small_batches, spread_join, staged, table
from aislewatch.llm.memo import forget
from aislewatch.llm.words import CHUNK, SPACE, Words, mix, shingle_sets, text_pieces

GROUP, GROUP_TOKENS = 512, 400_000  # classes in a group, and their tokens
FREQUENT = 16  # a token of so many sets counts as frequent
LEAD_ROWS = 250_000  # tokens of classes, and matrix rows, that meet in a part of one leader
MOST_FREQUENT = 1_000_000  # tokens that are broadcast as frequent: 12 MB
PIECE = CHUNK // 4  # bytes of text that are worked on at once
PREFIXES = 600_000  # tokens of prefixes that are dealt to buckets at once
MEETINGS = 1 << 18  # tokens that meet matrix rows at once


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set."""
    return int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)), int(mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64))


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    forget()
    for _, _, buf, off in text_pieces(texts, PIECE):
        yield from shingle_sets(Words(buf, off, SPACE), size)


def _repeated(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Tokens of two or more different sets among those of about 3 million tokens at a time, with their numbers of sets."""
    kept: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()

    def flush() -> pa.RecordBatch:
        t = np.concatenate([np.zeros(0, np.uint64), *kept])
        kept.clear()
        seen.clear()
        t.sort()
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        return pa.RecordBatch.from_arrays([pa.array(t[first].view(np.int64)), pa.array(last - first + 1)], names=["token", "n"])

    held = 0
    for batch in batches:
        own = [np.zeros(0, np.uint64)]
        for s in _sets(batch.column(0), size):
            if len(s) and (k := _key(s)) not in seen:
                seen.add(k)
                own.append(s)
        kept.append(np.concatenate(own))  # many small arrays that outlive a batch would keep freed memory from the system
        held += len(kept[-1])
        if held > 3_000_000:
            yield flush()
            held = 0
    yield flush()


class Often:
    """Frequent tokens, sorted, with their numbers of sets."""

    def __init__(self, token: np.ndarray, n: np.ndarray):
        order = np.argsort(token, kind="stable")
        self.token, self.n = token[order], n[order]

    def rank(self, s: np.ndarray) -> np.ndarray:
        """How often each token of ``s`` comes; 0 for those that aren't frequent."""
        if not len(self.token):
            return np.zeros(len(s), np.int32)
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        return np.where(self.token[at] == s, self.n[at], 0)


def frequent_tokens(docs: DataFrame, size: int) -> Often:
    """The most frequent tokens, MOST_FREQUENT (12 MB) at most. They only set the order of tokens, so any choice keeps
    the join exact; tokens that are alone in their part of the input aren't counted there."""
    rows = docs.select("text").mapInArrow(lambda b: _repeated(b, size), "token long, n long")
    top = rows.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    return Often(top.column("token").to_numpy().astype(np.int64).view(np.uint64), np.minimum(top.column("n").to_numpy(), 1 << 30).astype(np.int32))


def early(n: int) -> int:
    """How many common tokens a prefix has to show."""
    return max(1, n // 20)


def _prefix(s: np.ndarray, often: Often, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of a set in the order (number of sets, hash), and which of them are frequent."""
    p = min(len(s), len(s) - (percent * len(s) + 99) // 100 + early(len(s)))
    rank = often.rank(s)
    first = np.argsort(rank, kind="stable")[:p]
    return s[first], rank[first] > 0


def document_sets(docs: DataFrame, id_col: str, size: int) -> DataFrame:
    """_id, h1 and h2 (content), n (set size), k1 and k2 (of the set) of every row."""
    slim = docs.select(F.col(id_col).alias("_id"), "text", *content("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(s), *_key(s)) for s in _sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *[pa.array([g[c] for g in got], pa.int64()) for c in range(3)]], names=["_id", "h1", "h2", "n", "k1", "k2"])

    return staged(slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, h1 long, h2 long, n long, k1 long, k2 long"), "sets")


def _unpack(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _postings(batches: Iterator[pa.RecordBatch], often: Often, size: int, percent: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed (tokens, classes) of each bucket, for about PREFIXES tokens at a time; a class that comes again among those is left out.

    Other tokens go to a bucket of their hash, so that all their classes meet there; frequent ones go to further
    buckets by their class, so that no bucket has to hold all classes of one.
    """
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    seen: set[int] = set()

    def flush() -> pa.RecordBatch:
        token, hot, cls = (np.concatenate([x[c] for x in kept]) for c in range(3))
        kept.clear()
        seen.clear()
        b = (mix(np.where(hot, cls.view(np.uint64), token)) % np.uint64(buckets)).astype(np.int64) + hot * buckets
        order = np.argsort(b, kind="stable")
        ids, starts = np.unique(b[order], return_index=True)
        token, cls, ends = token[order], cls[order], [*starts[1:], len(order)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([token[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary()), pa.array([cls[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary())], names=["bucket", "tokens", "classes"])

    held = 0
    for batch in batches:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s in _sets(batch.column(0), size):
            if len(s) and (k := _key(s)[0]) not in seen:
                seen.add(k)
                own[k] = _prefix(s, often, percent)
        if own:
            kept.append((*(np.concatenate([x[c] for x in own.values()]) for c in range(2)), np.repeat(np.array(list(own), np.int64), [len(x) for x, _ in own.values()])))
            held += len(kept[-1][0])
        if held > PREFIXES:
            yield flush()
            held = 0
    if kept:
        yield flush()


def _shared(t: pa.Table, hot: bool) -> pa.Table:
    """(token, k1, often) of a bucket, each once; of other than frequent tokens those that more than one class has."""
    token, cls = np.concatenate(_unpack(t.column("tokens"))), np.concatenate(_unpack(t.column("classes")))
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls = token[new], cls[new]
    same = np.zeros(len(token) + 1, bool)
    same[1:-1] = token[1:] == token[:-1]
    more = same[1:] | same[:-1] | hot
    return pa.table({"token": pa.array(token[more].view(np.int64)), "k1": pa.array(cls[more].view(np.int64)), "often": pa.array(np.full(int(more.sum()), hot))})


def shared_tokens(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(token, k1, often): the prefix tokens that two or more classes have, and all frequent ones."""
    often = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, size))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(256, int(total // 4_000_000))
    packed = docs.select("text").mapInArrow(lambda b: _postings(b, often.value, size, percent, buckets), "bucket long, tokens binary, classes binary")
    out = staged(packed.groupBy("bucket").applyInArrow(lambda key, t: _shared(t, key[0].as_py() >= buckets), "token long, k1 long, often boolean"), "shared")
    often.destroy()
    return out


def _bitmap(rows: DataFrame, col: str) -> tuple[Callable[[str], Column], Broadcast]:
    """The place of a value in a bitmap of 16 MB at most, and that bitmap of the values of ``rows``, broadcast."""
    bits = 1 << 20
    while bits < 1 << 27 and bits < 32 * rows.count():
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    parts = rows.select(place(col).alias("b")).groupBy(F.shiftright("b", 15).alias("c")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(32767)).alias("m")).collect()
    full = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts:
        full[r.c] = np.frombuffer(r.m, np.uint8)
    return place, rows.sparkSession.sparkContext.broadcast(full.reshape(-1))


def _only(full: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of ``full`` whose classes a bitmap finds in ``wanted``, all of those and few others: a join then shuffles these sets alone."""
    place, shared = _bitmap(wanted, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((shared.value[b >> 3] >> (b & 7) & 1).astype(bool)))

    out = cut(full.select("cid", "set", place("cid").alias("_b")).mapInArrow(run, "cid long, set binary"))
    shared.destroy()
    return out


def sets_of(docs: DataFrame, live: DataFrame, id_col: str, size: int) -> DataFrame:
    """(cid, set) of the live classes, from the texts of their representatives (_rep).

    A bitmap of hashed ids (16 MB at most) spares most other texts; a join with the live classes leaves the rest out. A
    class may come twice if an id does.
    """
    place, shared = _bitmap(live, "_rep")
    slim = docs.select(F.col(id_col).alias("_rep"), "text", place(id_col).alias("_b"))
    kind = slim.schema["_rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy()
            hit = batch.filter(pa.array((shared.value[b >> 3] >> (b & 7) & 1).astype(bool)))
            got = [(*_key(s), s.tobytes()) for s in _sets(hit.column(1), size)]
            yield pa.RecordBatch.from_arrays([hit.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["_rep", "k1", "k2", "set"])

    found = slim.mapInArrow(run, f"_rep {kind}, k1 long, k2 long, set binary")
    same = [F.col("r1") == F.col("k1"), F.col("r2") == F.col("k2"), F.col("r").eqNullSafe(F.col("_rep"))]
    out = staged(found.join(live.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("_rep").alias("r"), "cid"), same).select("cid", "set"), "live")
    shared.destroy()
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """The smallest member that links reach, for each member of a group."""
    root = np.arange(len(link))
    while True:
        new = np.where(link, root[None, :], len(link)).min(axis=1)
        new = np.minimum(root, new)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _link_group(t: pa.Table, percent: int) -> pa.Table:
    """(comp, root): the links inside a group of a few hundred classes, as the component that each component reaches."""
    cid, first = np.unique(t.column("cid").to_numpy(), return_index=True)
    comp = t.column("comp").to_numpy()[first]
    sets = _unpack(t.column("set").take(pa.array(first)))
    n = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(cid)), n)
    col = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    member, col = member[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    member, col = member[order], col[order]
    both = np.zeros((len(cid), len(cid)))
    width = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, width, 8192):
        x, y = np.searchsorted(col, [a, a + 8192])
        m = np.zeros((len(cid), min(8192, width - a)), np.float32)
        m[member[x:y], col[x:y] - a] = 1
        both += m @ m.T
    link = (100 * both >= percent * (n[:, None] + n[None, :] - both)) | (comp[:, None] == comp[None, :])
    np.fill_diagonal(link, True)
    return pa.table({"cid": cid, "comp": comp, "root": comp[_roots(link)]})


def _open_groups(members: pa.Table, queries: pa.Table, percent: int) -> pa.Table:
    """(a, b): the components that links join, of the queries' and the group's."""
    joined: set[tuple[int, int]] = set()
    if members.num_rows and queries.num_rows:
        cid, first = np.unique(members.column("cid").to_numpy(), return_index=True)
        comp = members.column("comp").to_numpy()[first]
        comps = set(comp.tolist())
        sets = _unpack(members.column("set").take(pa.array(first)))
        n = np.array([len(s) for s in sets])
        order = np.argsort(np.concatenate(sets), kind="stable")
        token, owner = np.concatenate(sets)[order], np.repeat(np.arange(len(cid)), n)[order]
        union, start = np.unique(token, return_index=True)
        stop = np.append(start[1:], len(token))
        for own, s in zip(queries.column("comp").to_pylist(), _unpack(queries.column("qset")), strict=True):
            if all(c == own or (own, c) in joined for c in comps):
                continue
            at = np.minimum(np.searchsorted(union, s), len(union) - 1)
            at = at[union[at] == s]
            if 100 * len(at) < percent * len(s):  # the overlap with the union bounds that with each member
                continue
            both = np.bincount(np.concatenate([owner[x:y] for x, y in zip(start[at], stop[at], strict=True)]), minlength=len(cid))
            joined.update((own, c) for c in set(comp[100 * both >= percent * (len(s) + n - both)].tolist()) if c != own)
    return pa.table({"a": pa.array([x for x, _ in joined], pa.int64()), "b": pa.array([y for _, y in joined], pa.int64())})


def _chunks(count: str, tokens: str) -> Column:
    """Into how many groups of at most about GROUP classes and GROUP_TOKENS tokens so many go."""
    return F.greatest(F.ceil(F.col(count) / GROUP), F.ceil(F.col(tokens) / GROUP_TOKENS), F.lit(1))


def _by_token(entries: DataFrame, few: DataFrame, spread: int = 16) -> DataFrame:
    """``entries`` joined on the token with ``few``; the entries of frequent tokens are spread over ``spread`` salts by their class."""
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("cid", F.lit(3)), F.lit(spread))).otherwise(0).cast("int")
    copies = F.explode(F.when(F.col("often"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0))))
    return entries.withColumn("_salt", salt).join(few.withColumn("_salt", copies).drop("often"), ["token", "_salt"]).drop("_salt")


def _led(entries: DataFrame) -> DataFrame:
    """``entries`` with lead: of each token one class leads, the last by a hash. Tokens that come together mostly have one leader."""
    leaders = entries.groupBy("token", "often").agg(F.max_by("cid", F.xxhash64("cid")).alias("lead"))
    return cut(_by_token(entries, leaders).select("token", "often", "cid", "lead"), keep=True)


def _packs(live: DataFrame, entries: DataFrame) -> DataFrame:
    """(cid, n, lead, step): similar classes have one key (lead, step). A class follows the leader of most of its tokens;
    linked sets differ by a quarter in size at most, so a key also has a size step."""
    votes = entries.groupBy("cid", "lead").agg(F.count("*").alias("c"))
    chosen = votes.groupBy("cid").agg(F.max_by("lead", F.struct("c", "lead")).alias("lead"))
    return cut(live.select("cid", "n").join(chosen, "cid").withColumn("step", F.floor(F.log("n") / np.log(1.25)).cast("int")))


def _linked_packs(packs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b) of components that are found inside the packs, each cut into groups; the groups' roots are dealt to groups
    once more as long as that halves them, which ties large groups of near copies together at a cost in proportion to their size."""
    edges: DataFrame | None = None
    todo, level = packs, 0
    while True:
        load = todo.groupBy("lead", "step").agg(F.count("*").alias("c"), F.sum("n").alias("t")).where("c > 1").select("lead", "step", _chunks("c", "t").alias("chunks"))
        dealt = spread_join(todo, load, ["lead", "step"], ["cid"]).withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(level)), "chunks"))
        sets = dealt.join(_only(full, todo) if level else full, "cid").select("lead", "step", "chunk", "cid", F.col("cid").alias("comp"), "set")
        roots = cut(sets.groupBy("lead", "step", "chunk").applyInArrow(lambda t: _link_group(t, percent), "cid long, comp long, root long"))
        new = roots.where("comp <> root").select(F.col("comp").alias("a"), F.col("root").alias("b"))
        edges = new if edges is None else edges.unionByName(new)
        several = cut(dealt.where("chunks > 1"))
        todo = cut(several.join(roots.where("comp = root").select("cid"), "cid", "left_semi").select("cid", "n", "lead", "step"))
        if 2 * todo.count() > several.count() or todo.isEmpty():
            return edges
        level += 1


def _groups(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """(cid, n, comp, many, gid): a component of 32 classes or more is dealt to groups of its own, by hash; smaller ones
    are dealt to groups with others of their pack, each whole."""
    sizes = placed.groupBy("comp").agg(F.count("*").alias("many"), F.sum("n").alias("t")).join(packs.select(F.col("cid").alias("comp"), "lead", "step"), "comp")
    small = F.col("many") < 32
    load = sizes.where(small).groupBy("lead", "step").agg(F.sum("many").alias("c"), F.sum("t").alias("u")).select("lead", "step", _chunks("c", "u").alias("chunks"))
    packed = spread_join(sizes.where(small), load, ["lead", "step"], ["comp"]).withColumn("gid", F.xxhash64(F.lit(0), "lead", "step", F.pmod(F.xxhash64("comp", F.lit(9)), "chunks")))
    alone = sizes.where(~small).withColumn("chunks", _chunks("many", "t")).withColumn("gid", F.lit(None).cast("long"))
    cols = ["comp", "many", "chunks", "gid"]
    own = F.xxhash64(F.lit(1), "comp", F.pmod(F.xxhash64("cid", F.lit(9)), "chunks"))
    return cut(spread_join(placed, packed.select(*cols).unionByName(alone.select(*cols)), ["comp"], ["cid"]).select("cid", "n", "comp", "many", F.coalesce("gid", own).alias("gid")))


def _lookups(queries: pa.Table, matrix: pa.Table, percent: int) -> pa.Table:
    """(cid, to, c): how many of a class's tokens lead to each group that it may ask, from the classes' tokens (token, cid, n,
    comp, many, gid) and the matrix's rows (token, to, lo, hi, tmany, tcomp). About MEETINGS meetings are counted at a time."""
    out = {k: np.zeros(0, np.int64) for k in ("cid", "to", "c")}
    if queries.num_rows and matrix.num_rows:
        q = {c: queries.column(c).to_numpy() for c in ("token", "cid", "n", "comp", "many", "gid")}
        m = {c: matrix.column(c).to_numpy() for c in ("token", "to", "lo", "hi", "tmany", "tcomp")}
        order = np.argsort(m["token"], kind="stable")
        m = {c: x[order] for c, x in m.items()}
        lo, hi = np.searchsorted(m["token"], q["token"], "left"), np.searchsorted(m["token"], q["token"], "right")
        (cids, ci), (tos, ti) = (np.unique(x, return_inverse=True) for x in (q["cid"], m["to"]))
        upto = np.cumsum(hi - lo)
        pairs, counts, a = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while a < len(upto):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MEETINGS, "right")))
            n = (hi - lo)[a:b]
            x = np.repeat(np.arange(a, b), n)
            y = np.repeat(lo[a:b], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            fit = (q["gid"][x] != m["to"][y]) & (100 * m["hi"][y] >= percent * q["n"][x]) & (100 * q["n"][x] >= percent * m["lo"][y])
            fit &= (q["many"][x] < m["tmany"][y]) | (q["many"][x] == m["tmany"][y]) & (q["comp"][x] < m["tcomp"][y])
            pair, c = np.unique(ci[x[fit]] * len(tos) + ti[y[fit]], return_counts=True)
            pairs.append(pair)
            counts.append(c)
            a = b
        pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
        out = {"cid": cids[pair // len(tos)], "to": tos[pair % len(tos)], "c": np.bincount(back, np.concatenate(counts), len(pair)).astype(np.int64)}
    return pa.table(out)


def _ask(placed: DataFrame, packs: DataFrame, entries: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): the components that the token-group matrix finds links between.

    The matrix has a row for each token and group whose union of first tokens holds it. Of two components the smaller
    asks the larger's groups (ties by number); a class asks a group if sizes fit and enough of its first tokens lead
    there. Tokens meet the matrix by their leaders, a leader's tokens and matrix rows in several parts if they are
    many, so that what tokens of one passage say of a class and a group is summed before it moves on. Components of
    one group are compared in it.
    """
    least = f"(({percent} * n + 99) DIV 100)"
    show = lambda n: f"greatest(1L, {n} DIV 20)"  # noqa: E731  as early()
    dealt = _groups(placed, packs)
    several = dealt.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("gid")
    with scratch(full.sparkSession):
        inside = cut(dealt.join(several, "gid", "left_semi").select("gid", "cid", "comp"))
        inside = inside.join(_only(full, inside), "cid").select("gid", "cid", "comp", "set")
        inner = inside.groupBy("gid").applyInArrow(lambda t: _link_group(t, percent), "cid long, comp long, root long").where("comp <> root").select(F.col("comp").alias("a"), F.col("root").alias("b"))
        inner = cut(inner, keep=True)
    bounds = dealt.groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.struct("many", "comp")).alias("top")).select(F.col("gid").alias("to"), "lo", "hi", F.col("top.many").alias("tmany"), F.col("top.comp").alias("tcomp"))

    known = cut(entries.select("token", "lead", "cid").join(dealt, "cid"))
    matrix = cut(known.select("token", "lead", F.col("gid").alias("to")).distinct().join(bounds, "to"))
    parts = lambda df, name: df.groupBy("lead").agg(F.ceil(F.count("*") / LEAD_ROWS).alias(name)).where(f"{name} > 1")
    heavy = cut(parts(known, "parts").join(parts(matrix, "mparts"), "lead", "full").select("lead", F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("mparts", F.lit(1)).alias("mparts")))
    buckets = max(32, known.count() // LEAD_ROWS)
    keyed = lambda df, by: spread_join(df, heavy, ["lead"], by, "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "mparts": F.coalesce("mparts", F.lit(1)), "bucket": F.pmod(F.xxhash64("lead"), F.lit(buckets))})
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    left = keyed(known, ["cid"]).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(5)), "parts")).withColumn("mpart", every("mparts"))
    right = keyed(matrix, ["to"]).withColumn("mpart", F.pmod(F.xxhash64("to", F.lit(5)), "mparts")).withColumn("part", every("parts"))
    keys = ["bucket", "part", "mpart"]
    left, right = left.select(*keys, "token", "cid", "n", "comp", "many", "gid"), right.select(*keys, F.col("token").alias("token"), "to", "lo", "hi", "tmany", "tcomp")
    said = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda q, m: _lookups(q, m, percent), "cid long, to long, c long")
    asks = said.groupBy("cid", "to").agg(F.sum("c").alias("c")).join(dealt.select("cid", "n", "comp"), "cid").join(bounds.select("to", "lo"), "to")
    asks = cut(asks.where(f"c >= least({show('n')}, {show(f'greatest(lo, {least})')})").select("cid", "comp", "to"))

    parts = cut(asks.groupBy("to").agg(F.ceil(F.count("*") / 512).alias("parts")))
    queries = spread_join(asks, parts, ["to"], ["cid"]).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(5)), "parts")).join(_only(full, asks).withColumnRenamed("set", "qset"), "cid").select(F.col("to").alias("gid"), "part", "comp", "qset")
    asked = cut(dealt.join(parts.withColumnRenamed("to", "gid"), "gid").select("gid", "cid", "comp", "parts"))
    members = asked.join(_only(full, asked), "cid").withColumn("part", every("parts")).select("gid", "part", "cid", "comp", "set")
    keys = ["gid", "part"]
    return inner.unionByName(members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(lambda m, q: _open_groups(m, q, percent), "a long, b long"))


def _joined(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """``placed`` with the components that ``edges`` connect made one."""
    new = components(edges).withColumnsRenamed({"node": "comp", "component": "_to"})
    return cut(spread_join(placed, new, ["comp"], ["cid"], "left").select("cid", "n", F.coalesce("_to", "comp").alias("comp")), keep=True)


def _classed(docs: DataFrame, percent: int, size: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (:func:`document_sets`), and (k1, k2, least, rows) of each class whose component has several rows."""
    spark = docs.sparkSession
    with small_batches(spark):
        sets = document_sets(docs, id_col, size)
    with small_batches(spark), scratch(spark):
        classes = cut(sets.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("_id").alias("_rep"), F.count("*").alias("copies")).withColumn("cid", F.monotonically_increasing_id()))
        with scratch(spark):
            shared = shared_tokens(docs, sets, size, percent)
            counts = shared.groupBy("k1").agg(F.count("*").alias("c"))
            show = f"greatest(1L, (({percent} * n + 99) DIV 100) DIV 20)"  # as early()
            live = cut(classes.join(counts, "k1").where(f"c >= {show}").select("k1", "k2", "n", "_rep", "cid"), keep=True)
            entries = _led(cut(shared.join(live.select("k1", "cid"), "k1").select("token", "often", "cid")))
        full = sets_of(docs, live, id_col, size)
        packs = _packs(live, entries)
        with scratch(spark):
            placed = _joined(live.select("cid", "n", F.col("cid").alias("comp")), _linked_packs(packs, full, percent))
        with scratch(spark):
            placed = _joined(placed, _ask(placed, packs, entries, full, percent))

        known = classes.join(placed.select("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        found = known.groupBy("comp").agg(F.min("_rep").alias("least"), F.sum("copies").alias("rows")).where("rows > 1")
        return sets, cut(spread_join(known, found, ["comp"], ["cid"]).select("k1", "k2", "comp", "least", "rows"), keep=True)


def similar_components(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id (smallest id that links of ``percent`` or more reach).

    Null and empty texts have empty sets and are their own components. Fewer words than ``size`` are one shingle.
    Repeated rows and equal sets are in one component; texts of any length are read whole. An empty table gives an
    empty result; other columns are ignored.
    """
    sets, found = _classed(docs, percent, size, id_col)
    out = sets.select("_id", "n", "k1", "k2").join(found, ["k1", "k2"], "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "_id")).otherwise(F.col("_id")).alias("component_id"))


def op10_token_group_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM words WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT words.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least(words.doc_id, coalesce(r.m, words.doc_id)) AS component_id
FROM words LEFT JOIN size ON words.doc_id = size.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON words.doc_id = r.a
"""


def one_of_each(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that links of ``percent`` or more tie to a row that stays.

    Of each component the row with the smallest id stays (null ids count as the largest; of rows with one id, one by its
    content). Rows without words stay. Rows that repeat an id without a link are told apart by their texts. An empty
    table gives an empty result; columns of any name are carried along.
    """
    sets, found = _classed(docs, percent, size, id_col)
    rows = sets.where("n > 0").join(found.select("k1", "k2", "comp"), ["k1", "k2"])
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull().alias("nil"), "_id", "h1", "h2")).alias("first"))
    at = F.struct(F.col("_id").isNull().alias("nil"), "_id", "h1", "h2")
    gone = cut(spread_join(rows, first, ["comp"], ["_id", "h1"]).where(at != F.col("first")).select("_id", "h1", "h2").distinct())
    names = {c: f"_{c}_of_content" for c in ("_id", "h1", "h2")}
    h1, h2 = content("text")
    kept = docs.join(gone.withColumnsRenamed(names), F.col(id_col).eqNullSafe(F.col(names["_id"])) & (h1 == F.col(names["h1"])) & (h2 == F.col(names["h2"])), "left_anti")
    again = sets.where("n > 0").groupBy("_id", "h1", "h2").count().where("count > 1")
    if again.isEmpty():
        return kept
    twin = again.select(F.col("_id").alias(names["_id"]), F.col("h1").alias(names["h1"]), F.col("h2").alias(names["h2"]))
    same = F.col(id_col).eqNullSafe(F.col(names["_id"])) & (h1 == F.col(names["h1"])) & (h2 == F.col(names["h2"]))
    once = kept.join(twin, same, "left_semi").withColumn(names["h1"], h1).withColumn(names["h2"], h2).dropDuplicates([id_col, names["h1"], names["h2"]]).select(*docs.columns)
    return kept.join(twin, same, "left_anti").unionByName(once)
