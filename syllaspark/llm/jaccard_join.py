"""N-gram Jaccard join by prefix trees.

A document's set is that of its distinct shingles' hashes. All sets are ordered alike: shingles that many documents
have come last. Two sets that link share one of the first shingles in that order (the prefix filter), so each
distinct set is posted under its prefix. Candidates of one set, the hub, are put into a trie of their whole sets and
compared with the hub in one traversal: what paths share is compared once, and a subtree is left as soon as its
longest remaining path can't reach the overlap that its smallest set needs.

Only links that matter for the components are looked for: of the sets under a shingle, each is compared with one hub;
then sets that are still in another component than the hub's are compared with all others under that shingle that
are in other components. So no link between components is missed, and groups of copies don't cost all their pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, forget, mix, n_partitions, parts_for, ragged, repeated_ids, ship, shingles, stored, table, texts_of, tidy, words_of
from .components import components

#: Shingles that more sets have than this are ordered last, at most HOT_MOST of them, the most frequent; it is a matter of speed only.
#: Repeats are counted within stretches of COUNT_ITEMS shingles: a shingle of f sets in b stretches shows about f * f / b of them.
HOT, HOT_MOST, COUNT_ITEMS = 3, 400_000, 4_000_000
BLOCK_BYTES, PART_BYTES = 2_000_000, 12_000_000
#: Sets in one trie at most, and pairs that a task compares, about.
TRIE_SETS, TASK_PAIRS = 512, 5_000
#: Ids of texts to be read again that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_I64, _U64, _I32 = np.int64, np.uint64, np.int32


def sets_of(texts: pa.StringArray, n: int, lower: bool = True) -> list[np.ndarray]:
    """The ordered distinct n-word shingle hashes of each text; of fewer words, one for all of them; none without words."""
    w = words_of(texts, SPACE, lower=lower)
    h = w.hashes()
    all_ = shingles(h, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        own = np.sort(all_[a : b - n + 1]) if b - a >= n else shingles(h[a:b], b - a) if b > a else all_[:0]
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def signature(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    return int(mix(mix(s).sum(dtype=_U64, keepdims=True) + _U64(len(s))).astype(_I64)[0])


class Order:
    """The global order of shingles: by how many sets have them, unknown ones as none, then by hash."""

    def __init__(self, hot: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(hot)
        self.hot, self.rank = hot[order], rank[order].astype(_I64)

    def ranks(self, s: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(s), _I64)
        i = np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)
        return np.where(self.hot[i] == s, self.rank[i], 0)

    def sorted(self, s: np.ndarray) -> np.ndarray:
        """An ascending set in the global order."""
        r = self.ranks(s)
        return s[np.argsort(r, kind="stable")] if r.any() else s


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of sets of a and b items that link: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


class Trie:
    """Ordered sets by common beginnings; a node has a stretch of items that no set below it leaves."""

    __slots__ = ("items", "children", "owners", "longest", "smallest")

    def __init__(self, items: np.ndarray) -> None:
        self.items, self.children, self.owners = items, {}, []
        self.longest, self.smallest = 0, 1 << 60

    def add(self, s: np.ndarray, owner: int) -> None:
        node, at, n = self, 0, len(s)
        while True:
            node.longest, node.smallest = max(node.longest, n - at), min(node.smallest, n)
            if at == n:
                node.owners.append((owner, n))
                return
            child = node.children.get(int(s[at]))
            if child is None:
                child = Trie(s[at:])
                child.owners.append((owner, n))
                child.smallest = n
                node.children[int(s[at])] = child
                return
            m = min(len(child.items), n - at)
            differs = np.flatnonzero(child.items[:m] != s[at : at + m])
            same = int(differs[0]) if len(differs) else m
            if same < len(child.items):  # the stretch is cut where they part
                top = Trie(child.items[:same])
                child.items = child.items[same:]
                top.children[int(child.items[0])] = child
                top.longest, top.smallest = child.longest + len(child.items), child.smallest
                node.children[int(s[at])] = top
                child = top
            node, at = child, at + same

    def linked(self, hub: np.ndarray, percent: int) -> list[int]:
        """Owners of the sets that link with the hub (ascending hashes, of any order)."""
        out, stack = [], [(self, 0, len(hub))]
        while stack:
            node, overlap, left = stack.pop()
            if len(node.items):
                i = np.minimum(np.searchsorted(hub, node.items), len(hub) - 1)
                got = int((hub[i] == node.items).sum())
                overlap, left = overlap + got, left - got
            if overlap + min(left, node.longest) < needed(len(hub), node.smallest, percent):
                continue
            out += [o for o, n in node.owners if overlap >= needed(len(hub), n, percent)]
            stack += [(c, overlap, left) for c in node.children.values()]
        return out


def _described(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: doc_id, n_shingles, sig of each document; and gram, n of shingles that several sets of a stretch of COUNT_ITEMS shingles have."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(ids: pa.Array, sizes: list, sigs: list, gram: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        x, g = len(ids), len(gram)
        columns = [
            pa.concat_arrays([ids, pa.nulls(g, ids.type)]),
            pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(g, pa.int64())]),
            pa.concat_arrays([pa.array(sigs, pa.int64()), pa.nulls(g, pa.int64())]),
            pa.concat_arrays([pa.nulls(x, pa.int64()), pa.array(gram.astype(_I64))]),
            pa.concat_arrays([pa.nulls(x, pa.int64()), pa.array(many.astype(_I64))]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "sig", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        none = np.zeros(0, _U64)

        def repeated(ids: pa.Array) -> Iterator[pa.RecordBatch]:
            every = np.concatenate([*held, none])
            held.clear()
            seen.clear()
            every.sort()
            head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, _I64)
            many = np.diff(np.append(head, len(every)))
            gram, many = every[head[many > 1]], many[many > 1]
            for k in range(0, len(gram), 1 << 16):
                yield rows(ids.slice(0, 0), [], [], gram[k : k + (1 << 16)], many[k : k + (1 << 16)])

        ids = None
        for b in cut(batches, "_text", BLOCK_BYTES):
            sets, ids = sets_of(texts_of(b, "_text"), n), b.column(0)
            sigs = [signature(s) if len(s) else None for s in sets]
            yield rows(ids, [len(s) for s in sets], sigs, none, none)
            for g, s in zip(sigs, sets, strict=True):
                if g is not None and g not in seen:
                    seen.add(g)
                    held.append(s)
            if sum(map(len, held)) > COUNT_ITEMS:
                yield from repeated(ids)
        if held:
            yield from repeated(ids)

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, sig long, gram long, n long")


def _postings(docs: DataFrame, n: int, percent: int, order: Broadcast, parts: int) -> DataFrame:
    """gram, sig, size, place of each distinct set under each shingle of its prefix, for shingles that two sets have."""
    kinds = (_U64, _I64, _I32, _I32)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in cut(batches, "_text", BLOCK_BYTES):
            rows = []
            if len(seen) > 2_000_000:
                seen.clear()
            for s in sets_of(texts_of(b, "_text"), n):
                if not len(s) or (g := signature(s)) in seen:
                    continue
                seen.add(g)
                m = len(s)
                prefix = m - int(needed_alone(m, percent)) + 1
                rows.append((order.value.sorted(s)[:prefix], g, m))
            if not rows:
                continue
            size = np.array([len(r[0]) for r in rows])
            gram = np.concatenate([r[0] for r in rows])
            sig, m = (np.repeat(np.array([r[k] for r in rows], _I64), size) for k in (1, 2))
            place = ragged(np.zeros(len(size), _I64), size)
            # A hot shingle's sets are dealt over many parts; they only pass through.
            spread = np.where(order.value.ranks(gram) > 0, sig.astype(_U64) % _U64(64), _U64(0))
            part = (mix(gram + spread) % _U64(parts)).astype(_I64)
            by = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[by], np.arange(parts + 1))
            columns = [a[by].astype(k) for a, k in zip((gram, sig, m, place), kinds, strict=True)]
            used = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([c[ends[p] : ends[p + 1]].tobytes() for p in used], pa.binary()) for c in columns)], ["part", "gram", "sig", "size", "place"])

    def meet(group: pa.Table) -> pa.Table:
        gram, sig, size, place = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in zip(("gram", "sig", "size", "place"), kinds, strict=True))
        by = np.lexsort((sig, gram))
        gram, sig, size, place = gram[by], sig[by], size[by], place[by]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])])
        gram, sig, size, place = gram[new], sig[new], size[new], place[new]
        head = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        many = np.repeat(np.diff(np.append(head, len(gram))), np.diff(np.append(head, len(gram))))
        use = (many > 1) | (order.value.ranks(gram) > 0)
        return pa.table({"gram": pa.array(gram[use].astype(_I64)), "sig": pa.array(sig[use]), "size": pa.array(size[use]), "place": pa.array(place[use])})

    posted = docs.select("_text").mapInArrow(post, "part int, gram binary, sig binary, size binary, place binary")
    return posted.groupBy("part").applyInArrow(meet, "gram long, sig long, size int, place int")


def needed_alone(n: int, percent: int) -> int:
    """The least overlap of a set of n items with any set that it links with."""
    return -(-percent * n // 100)


def _may_link(percent: int):
    """Whether two postings of a shingle, x and y, may be of sets that link, as far as sizes and places tell if no earlier shingle is in both."""
    small, large = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    rest = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    return (small * 100 >= large * percent) & (rest * (100 + percent) >= (F.col("x_size") + F.col("y_size")) * percent)


def _as(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select("gram", *(F.col(n).alias(f"{side}_{n}") for n in names))


def _verified(pairs: DataFrame, content: DataFrame, n: int, percent: int, order: Broadcast) -> DataFrame:
    """a, b of the pairs (hub a, set b) that link. A hub's candidates are dealt into tries of TRIE_SETS."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).alias("_k"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_k")).alias("chunk"))
    dealt = stored(dealt)
    hubs = dealt.select("a", "chunk").distinct().join(content.withColumnRenamed("sig", "a"), "a").select("a", "chunk", F.lit(None).cast("long").alias("b"), "body")
    members = dealt.join(content.withColumnRenamed("sig", "b"), "b").select("a", "chunk", "b", "body")
    rows = hubs.unionByName(members)
    parts = max(n_partitions(pairs.sparkSession), dealt.count() // TASK_PAIRS)
    rows = rows.repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub, trie, found = None, None, None, []

        def close() -> None:
            if trie is not None:
                found.extend((now[0], b) for b in trie.linked(hub, percent))

        def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
            """The rows with their texts, in slices of about BLOCK_BYTES of text once unpacked."""
            texts, size, first = [], 0, 0
            for k, body in enumerate(batch.column(3)):
                texts.append(zlib.decompress(body.as_py()))
                size += len(texts[-1])
                if size >= BLOCK_BYTES or k + 1 == batch.num_rows:
                    yield batch.slice(first, len(texts)), [x.decode() for x in texts]
                    texts, size, first = [], 0, k + 1

        tidy()
        for batch in batches:
            for piece, texts in slices(batch):
                a, chunk, b = (piece.column(c).to_pylist() for c in range(3))
                sets = sets_of(pa.array(texts, pa.string()), n)
                for key, member, s in zip(zip(a, chunk, strict=True), b, sets, strict=True):
                    if key != now:
                        close()
                        now, hub, trie = key, s, Trie(s[:0])
                    if member is not None:
                        trie.add(order.value.sorted(s)[::-1], member)  # the frequent first: those are what many share
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        close()
        tidy()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _packed(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """sig, body (a packed text that has that set) of the sets in pairs (a, b): a text is read again only if its set has a candidate.

    The ids of those texts are broadcast up to BROADCAST_IDS of them; beyond that the texts are shuffled.
    """
    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    one = stored(members.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("_id")))
    few = one.count() <= BROADCAST_IDS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(x.encode(), 1) for x in b.column(1).to_pylist()], pa.binary())], ["sig", "body"])

    found = docs.join(F.broadcast(one) if few else one, docs["doc_id"] == one["_id"])
    return found.select("sig", F.coalesce("_text", F.lit("")).alias("_text")).mapInArrow(pack, "sig long, body binary")


def join(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Texts are lower-cased (A-Z), words are parted by ASCII white space. Two documents link when the overlap of their
    sets is at least `percent` hundredths of the union; component_id is the smallest id reachable by links. Null and
    empty texts have no set and are linked with nothing, equal ids apart. Rows with a null id are left out of the
    comparison: their component_id is null. Ids should not repeat with different texts; rows that repeat id and text
    have the same result. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    known = ids.where(F.col("doc_id").isNotNull())
    both = stored(_described(ids, n))
    described = both.where(F.col("n_shingles").isNotNull()).select("doc_id", "n_shingles", "sig")
    top = both.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).orderBy(F.desc("n"), "gram").limit(HOT_MOST).toArrow()
    order = spark.sparkContext.broadcast(Order(top.column("gram").to_numpy().astype(_U64), top.column("n").to_numpy()))
    postings = stored(_postings(known, n, percent, order, parts_for(ids, PART_BYTES)))
    members = described.where(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())

    # First round: each set against its shingle's hub, the set in which the shingle comes first.
    hubs = postings.groupBy("gram").agg(F.min(F.struct("place", "size", "sig")).alias("h")).select("gram", "h.*")
    x, y = _as(hubs, "x", "sig", "size", "place"), _as(postings, "y", "sig", "size", "place")
    near = y.join(x, "gram").where((F.col("x_sig") != F.col("y_sig")) & _may_link(percent))
    pairs = stored(near.select(F.col("x_sig").alias("a"), F.col("y_sig").alias("b")).distinct())
    content = stored(_packed(known, members, pairs))
    links = stored(_verified(pairs, content, n, percent, order))
    forget(content)
    roots = stored(components(links))

    # Second round: sets that are in another component than their hub's, against all that are in others than theirs.
    named = postings.join(roots, postings["sig"] == roots["node"], "left").select("gram", "sig", "size", "place", F.coalesce("root", "sig").alias("root"))
    named = stored(named)
    hub_root = named.groupBy("gram").agg(F.min(F.struct("place", "size", "sig", "root")).alias("h")).select("gram", F.col("h.root").alias("hub_root"), F.col("h.sig").alias("hub_sig"))
    minor = named.join(hub_root, "gram").where(F.col("root") != F.col("hub_root")).select("gram", "sig", "size", "place", "root", "hub_sig")
    minor = stored(minor)
    x, y = _as(minor, "x", "sig", "size", "place", "root", "hub_sig"), _as(named, "y", "sig", "size", "place", "root")
    near = y.join(x, "gram").where((F.col("x_root") != F.col("y_root")) & (F.col("y_sig") != F.col("x_hub_sig")) & _may_link(percent))
    more = stored(near.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct())
    forget(postings, named, minor)
    content = stored(_packed(known, members, more))
    rest = stored(_verified(more, content, n, percent, order))
    forget(content)
    again = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))

    # Of equal sets, and then of linked ones, the smallest id.
    least = members.groupBy("sig").agg(F.min("doc_id").alias("_least"))
    placed = least.join(again, least["sig"] == again["node"], "left").select("sig", "_least", F.coalesce("root", "sig").alias("root"))
    low = placed.groupBy("root").agg(F.min("_least").alias("_low"))
    final = placed.join(low, "root").select(F.col("sig").alias("_sig"), "_low")
    # Documents without a set are in no component; a join would send them all to one task.
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_low", "doc_id")).alias("component_id")
    named = described.where(F.col("sig").isNotNull()).join(final, F.col("sig") == F.col("_sig"), "left").select("doc_id", "n_shingles", own)
    return named.unionByName(described.where(F.col("sig").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns, one of those that repeat id and text; rows with a null id stay."""
    first = join(docs, n, percent, doc_id, text).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    null = docs.where(F.col(doc_id).isNull())
    again = repeated_ids(docs.where(F.col(doc_id).isNotNull()), doc_id)
    same = F.col(doc_id) == F.col("_first")
    if again is None:
        return docs.join(first, same, "left_semi").unionByName(null)
    once = docs.join(first.join(again, F.col("_first") == F.col("_again"), "left_anti"), same, "left_semi")
    many = docs.join(again, F.col(doc_id) == F.col("_again"), "left_semi").join(first, same, "left_semi")
    many = many.withColumn("_sha", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)).dropDuplicates([doc_id, "_sha"]).drop("_sha")
    return once.unionByName(many).unionByName(null)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: Too slow in SQL over whole tables; the query is tested against a brute-force version.
SQL = None
