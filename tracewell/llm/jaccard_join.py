"""N-gram Jaccard join: exact links of 75 % on 5-word shingles, and their components, by signature trees.

1. Texts become sets; equal sets become one class (least doc_id), aggregated before the shuffle.
2. Every class posts the first quarter of its set in one global order: rare tokens by hash, tokens that are
   frequent in a bounded sample last. Linked sets share a posted token, whatever the order, so the sample affects only speed.
3. The sets of a token that are neighbours by size are tested by their bitmaps; what may reach the similarity is put in one
   cluster. These pairs are hints: they only make the next step smaller.
4. The sets of a token that lie in several clusters form a signature tree, whose nodes hold OR-combined bitmaps, size ranges and
   cluster ranges; a dual traversal finds every pair across clusters that may reach the similarity and merges the two. From then
   on all links lie within clusters.
5. The text of each class goes once to its cluster (a large one is cut into chunks). A signature tree over whole sets is
   traversed against itself; only links that join components leave it, so a group of thousands of near copies emits about its
   size, and no link that could add to a component is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._shared import discard, small_batches, stage, tidied
from tracewell.llm.graph_components import components
from tracewell.llm.id_filter import id_filter
from tracewell.llm.shingles import fingerprints, shingle_sets
from tracewell.llm.signature_tree import PERCENT, SignatureTree, bitmap, least_overlap, linked_weights, may_reach, merging_pairs, tree_links
from tracewell.llm.words import mix64, slices

#: Neighbours of a set among those of one token: so many places on in size order, and the first.
STRIDES = (1, 2, 4, 8, 16, 32)
#: Sets of one tree of step 4; a token of more sets is cut into runs by size, and pairs of runs are trees of their own.
TREE_SETS = 2048
#: Tokens of one tree of step 5, and the sets of a larger cluster that all of its chunks share.
CHUNK_TOKENS = 2_000_000
ANCHORS = 16
#: Bounds of the sample that orders frequent tokens, and of the list that is broadcast (12 bytes a token).
SAMPLE_DOCS = 10_000
FREQUENT = 4
MAX_FREQUENT = 1_000_000
SEEN_CLASSES = 500_000
#: Rows of postings that are looked at together.
STEP = 250_000


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, one, two (fingerprints), bits (bitmap) of every row, stored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in slices(whole)):
            rows = [(len(s), *fingerprints(s), bitmap(s).tobytes()) for s in shingle_sets(batch.column("text"))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "one", "two", "bits"])

    return stage(_narrow(docs).mapInArrow(tidied(run), "doc_id long, n long, one long, two long, bits binary"), "sets")


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in order, rank of each) of those in FREQUENT or more documents of a sample of about SAMPLE_DOCS."""
    there, million = docs.count(), 1_000_000
    part = min(million, max(1, SAMPLE_DOCS * million // max(1, there)))

    def run(batches):
        held: list[np.ndarray] = []
        for batch in (x for whole in batches for x in slices(whole)):
            held += [s for s in shingle_sets(batch.column("text")) if len(s)]
        if held:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], ["token", "df"])

    sample = _narrow(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < part)
    counted = sample.mapInArrow(tidied(run), "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= FREQUENT)
    table = counted.orderBy(F.desc("df"), "token").limit(MAX_FREQUENT).toArrow()
    tokens = np.asarray(table.column("token")).astype(np.int64).view(np.uint64)[::-1]
    rank = np.arange(len(tokens), dtype=np.int32)
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def posted(row: np.ndarray, tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The prefix of a set in the global order: linked sets share one of these tokens."""
    length = len(row) - -(-len(row) * PERCENT // 100) + 1
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, row), len(tokens) - 1)
        often = tokens[at] == row
        if often.any():
            row = np.concatenate((row[~often], row[often][np.argsort(rank[at[often]], kind="stable")]))
    return row[:length]


#: Postings carry 48 bits of a token and of a set's fingerprint. Where two share them, they meet in a tree more than they need to.
SHORT_BITS = 48


def _short(one: F.Column) -> F.Column:
    return one.bitwiseAND(F.lit((1 << SHORT_BITS) - 1))


def postings(docs: DataFrame, tokens: np.ndarray, rank: np.ndarray) -> DataFrame:
    """token, key, n, place; a task posts equal sets once (as long as it remembers them)."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, rank))
    low = (1 << SHORT_BITS) - 1

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in (x for whole in batches for x in slices(whole)):
            out: list[tuple[int, int, np.ndarray]] = []
            for row in shingle_sets(batch.column("text")):
                mark = fingerprints(row)
                if len(row) and mark not in seen:
                    if len(seen) >= SEEN_CLASSES:
                        seen.clear()
                    seen.add(mark)
                    out.append((mark[0] & low, len(row), posted(row, *shared.value)))
            for k in range(0, len(out), 1000):
                part = out[k : k + 1000]
                lengths = [len(p) for _, _, p in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((np.concatenate([p for _, _, p in part]) & np.uint64(low)).view(np.int64)),
                        pa.array(np.repeat(np.asarray([o for o, _, _ in part], np.int64), lengths)),
                        pa.array(np.repeat(np.asarray([n for _, n, _ in part], np.int32), lengths)),
                        pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in lengths])),
                    ],
                    ["token", "key", "n", "place"],
                )

    return _narrow(docs).mapInArrow(tidied(run), "token long, key long, n int, place int")


def _fits(n_a, place_a, n_b, place_b):
    """Whether two sets whose first shared token has these places can reach the similarity."""
    need = least_overlap(n_a, n_b)
    return (place_a <= n_a - need) & (place_b <= n_b - need)


def _runs(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(columns, run begins, run ends) of rows sorted by their first column; a run is never cut."""
    held: list[list] = []

    def joined():
        return [pa.concat_arrays([h[k] for h in held]) for k in range(len(names))]

    def cut(columns, last: bool):
        key = np.asarray(columns[0])
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(begin[1:], len(key))
        return (begin, end, len(key)) if last else (begin[:-1], end[:-1], int(begin[-1]))

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c) for c in names])
        rows += batch.num_rows
        if rows < STEP:
            continue
        columns = joined()
        begin, end, stop = cut(columns, False)
        if len(begin):
            yield columns, begin, end
        held = [[c.slice(stop) for c in columns]]
        # a run that outgrows the step is gathered in larger and larger steps
        rows = 0
    if held:
        columns = joined()
        if len(columns[0]):
            begin, end, _ = cut(columns, True)
            yield columns, begin, end


def neighbours(posts: DataFrame) -> DataFrame:
    """Stored rows (token, a, n, place) of every token that two sets post, and pairs (token null, a, b) of neighbours by size."""
    names = ("token", "key", "n", "place")
    schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])

    def run(batches):
        for columns, _, _ in _runs(batches, names):
            token, key, n, place = map(np.asarray, columns)  # rows come by token, n, key
            keep = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])))
            token, key, n, place = token[keep], key[keep], n[keep].astype(np.int64), place[keep].astype(np.int64)
            again = token[1:] == token[:-1]
            more = np.concatenate((again, [False])) | np.concatenate(([False], again))
            token, key, n, place = token[more], key[more], n[more], place[more]
            if not len(token):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(key), pa.nulls(len(token), pa.int64()), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], schema=schema)
            every = np.arange(len(token))
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            first = np.repeat(first, np.diff(np.append(first, len(token))))
            found = []
            for i, j in [(every[:-w], every[w:]) for w in STRIDES] + [(first, every)]:
                ok = (token[i] == token[j]) & (key[i] != key[j])
                i, j = i[ok], j[ok]
                ok = _fits(n[i], place[i], n[j], place[j])
                found.append(np.stack((np.minimum(key[i[ok]], key[j[ok]]), np.maximum(key[i[ok]], key[j[ok]]))))
            a, b = np.concatenate(found, axis=1)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            if len(a):
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                a, b = a[new], b[new]
                none = pa.nulls(len(a), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), none, none], schema=schema)

    ordered = posts.repartition("token").sortWithinPartitions("token", "n", "key")
    return stage(ordered.mapInArrow(tidied(run), "token long, a long, b long, n int, place int"), "neighbours")


def hopeful_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs(a, b: keys) whose bitmaps leave the similarity possible, stored."""
    side = lambda k: classes.select(F.col("key").alias(f"{k}_key"), F.col("n").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))

    def bound(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_bits", "b_bits", "a_n", "b_n")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([may_reach(*r) for r in rows], pa.bool_()))

    near = pairs.join(side("a"), F.col("a") == F.col("a_key")).join(side("b"), F.col("b") == F.col("b_key"))
    return stage(near.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInArrow(tidied(bound), "a long, b long"), "near")


def partnered(begin, end, part, n, place, tree_sets: int) -> np.ndarray:
    """Rows that some row of the same run and of another part fits by sizes and places; all rows of runs beyond tree_sets."""
    stop = np.repeat(end, end - begin)
    able = stop - np.repeat(begin, end - begin) > tree_sets
    i, w = np.flatnonzero(~able), 1
    while len(i := i[i + w < stop[i]]):
        j = i + w
        ok = (part[i] != part[j]) & _fits(n[i], place[i], n[j], place[j])
        able[i[ok]] = able[j[ok]] = True
        w += 1
    return able


def tree_pairs(wide: DataFrame, classes: DataFrame, clusters: DataFrame, tree_sets: int = TREE_SETS) -> DataFrame:
    """Pairs (a, b: keys) that merge clusters as every pair of sets of one token that may reach the similarity would, stored.

    wide(token, a, n, place), clusters(node, component). Bitmaps are fetched only for tokens whose sets lie in several clusters."""
    names = ("token", "part", "n", "place", "a")

    def mixed(batches):
        for columns, begin, end in _runs(batches, names):
            token, part, n, place, _ = (np.asarray(c) for c in columns)
            able = partnered(begin, end, part, n.astype(np.int64), place.astype(np.int64), tree_sets)
            rows, trees = [], []
            apart = np.add.reduceat(able, begin) > 1
            for x, y in zip(begin[apart].tolist(), end[apart].tolist(), strict=True):
                order = x + np.flatnonzero(able[x:y])  # rows come by token, n
                cuts = [order[k : k + tree_sets] for k in range(0, len(order), tree_sets)]
                for i, p in enumerate(cuts):
                    for j, q in enumerate(cuts[i:], i):
                        if 100 * n[p[-1]] >= PERCENT * n[q[0]]:
                            both = p if i == j else np.concatenate((p, q))
                            rows.append(both)
                            trees.append(np.full(len(both), (int(token[x]) * 4_000_037 + i * 2003 + j) % (1 << 64), np.uint64))
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(mix64(np.concatenate(trees)).view(np.int64)), *(c.take(take) for c in columns[1:])], ["tree", *names[1:]])

    def trees(batches):
        for columns, begin, end in _runs(batches, ("tree", "part", "n", "place", "a", "bits")):
            part, n, place, a = (np.asarray(c).astype(np.int64) for c in columns[1:5])
            out = []
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                if y - x > 1:
                    bits = [np.frombuffer(r, "<u8") for r in columns[5].slice(x, y - x).to_pylist()]
                    out += [(a[x + i], a[x + j]) for i, j in merging_pairs(n[x:y], place[x:y], part[x:y], bits)]
            if out:
                found = np.unique(np.asarray(out, np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    parts = clusters.select("node", "component")
    placed = wide.join(parts, F.col("a") == F.col("node"), "left").select("token", F.coalesce("component", "a").alias("part"), "n", "place", "a")
    left = stage(placed.repartition("token").sortWithinPartitions("token", "n").mapInArrow(tidied(mixed), "tree long, part long, n int, place int, a long"), "mixed")
    bits = classes.select("key", "bits")
    dressed = left.join(bits, F.col("a") == F.col("key")).select("tree", "part", "n", "place", "a", "bits")
    found = stage(dressed.repartition("tree").sortWithinPartitions("tree").mapInArrow(tidied(trees), "a long, b long").distinct(), "tree-pairs")
    discard(left)
    return found


def chunked(members: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """members(rep, one, two, n, part) of clusters of two sets or more, with chunks (of about chunk_tokens tokens) and own (the
    number of a set's chunk); sets and tokens of a cluster are pre-aggregated, so that a hot cluster costs one row there."""
    totals = members.groupBy("part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1")
    totals = totals.select(F.col("part").alias("t_part"), "sets", F.ceil(F.col("tokens") / chunk_tokens).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("one", "two"), F.col("chunks")).cast("int")
    return members.join(totals, F.col("part") == F.col("t_part")).select("rep", "one", "two", "n", "part", "sets", "chunks", own.alias("own"))


def _cluster_trees(docs: DataFrame, dealt: DataFrame, columns: tuple[str, ...], walk, schema: str) -> DataFrame:
    """dealt(rep, one, two, tree, columns) -> the rows (of longs) that walk(rep, one, two, columns, sets) gives for the members of each `tree`.

    Each row's text is fetched once a tree; whole sets of a tree are in one task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for held, begin, end in _runs(batches, ("tree", "rep", "one", "two", *columns, "text")):
            fixed = [np.asarray(c) for c in held[1:-1]]
            out: list[np.ndarray] = []
            for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                known: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
                # rows of one id may hold several texts, of which one is this class
                for k, s in enumerate(shingle_sets(held[-1].slice(x, y - x)), x):
                    if (mark := fingerprints(s)) == (int(fixed[1][k]), int(fixed[2][k])):
                        known.setdefault(mark, (k, s))
                if len(known) > 1:
                    at = np.asarray([k for k, _ in known.values()])
                    out.append(walk(*(c[at] for c in fixed), [s for _, s in known.values()]))
            if any(map(len, out)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names)

    narrow = _narrow(docs).filter("doc_id is not null")
    texts = narrow.filter(id_filter(dealt.select(F.col("rep").alias("id")))("doc_id"))
    full = texts.join(dealt, F.col("doc_id") == F.col("rep")).select("tree", "rep", "one", "two", *columns, "text")
    return full.repartition("tree").sortWithinPartitions("tree").mapInArrow(tidied(run), schema)


def cluster_links(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt(rep, one, two, label, tree) -> links (a, b: least doc_ids of classes) that join labels within the trees, stored."""

    def walk(rep, one, two, label, sets):
        links = tree_links(np.asarray(list(map(len, sets)), np.int64), label, sets, STRIDES)
        return rep[np.asarray(links, np.int64).reshape(-1, 2)]

    return stage(_cluster_trees(docs, dealt, ("label",), walk, "a long, b long").distinct(), "cluster-links")


def cluster_weights(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """dealt(rep, one, two, label, weight, tree) -> one, two, linked: the weight of all that a set links with in a tree, across its two labels
    or, where the label is -1, among all members; stored."""

    def walk(rep, one, two, label, weight, sets):
        parts = np.arange(len(sets)) if label[0] == -1 else label
        total = linked_weights(np.asarray(list(map(len, sets)), np.int64), parts, sets, weight)
        some = total > 0
        return np.stack((one[some], two[some], total[some]), axis=1)

    return stage(_cluster_trees(docs, dealt, ("label", "weight"), walk, "one long, two long, linked long"), "cluster-weights")


def dealt_clusters(docs: DataFrame, rows: DataFrame, members: DataFrame, chunk_tokens: int = CHUNK_TOKENS, tree_sets: int = TREE_SETS) -> DataFrame:
    """members in clusters that no link leaves, cut into chunks (see chunked), stored. rows: describe(docs)."""
    classes = members.select("key", "n", "bits")
    found = neighbours(postings(docs, *frequent_tokens(docs)))
    near = hopeful_pairs(found.filter("token is null").select("a", "b").distinct(), classes)
    clusters = stage(components(near), "clusters")
    more = tree_pairs(found.filter("token is not null").select("token", "a", "n", "place"), classes, clusters, tree_sets)
    if not more.isEmpty():
        # the clusters so far stand for the pairs they came from
        clusters = stage(components(clusters.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "clusters")
    discard(found, near, more)
    placed = members.join(clusters, F.col("key") == F.col("node")).select("rep", "one", "two", "n", F.col("component").alias("part"))
    return stage(chunked(placed, chunk_tokens), "chunks")


def similarity_links(docs: DataFrame, rows: DataFrame, members: DataFrame, chunk_tokens: int = CHUNK_TOKENS, tree_sets: int = TREE_SETS) -> DataFrame:
    """Links (a, b: least doc_ids of classes) that join components as all links would. rows: describe(docs); members: its classes."""
    dealt = dealt_clusters(docs, rows, members, chunk_tokens, tree_sets)
    # sets of a large cluster that every chunk holds, so that chunks of one component are joined by them
    anchor = F.pmod(F.xxhash64("two", "one"), F.lit(1_000_000)) < F.lit(1_000_000 * ANCHORS) / F.col("sets")
    chunk = F.when(anchor, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))
    first = dealt.select("rep", "one", "two", F.xxhash64("one", "two").alias("label"), F.explode(chunk).alias("chunk"), "part")
    links = cluster_links(docs, stage(first.select("rep", "one", "two", "label", F.xxhash64("part", "chunk").alias("tree")), "first"))
    large = dealt.filter("chunks > 1")
    if large.isEmpty():
        return links
    label = components(links)
    large = stage(large.join(label, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")), "large")
    several = large.groupBy("part").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("part")
    ways = F.sequence(F.lit(0), F.col("chunks") - 1)
    rest = large.join(several, "part").select("rep", "one", "two", "label", "part", "own", F.explode(ways).alias("other")).filter("own <> other")
    tree = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))
    return links.unionByName(cluster_links(docs, stage(rest.select("rep", "one", "two", "label", tree.alias("tree")), "rest")))


def set_classes(rows: DataFrame) -> DataFrame:
    """one, two, n, rep (least doc_id), copies (rows with an id), bits, key of the sets that are not empty, stored. rows: describe(docs)."""
    found = rows.filter("n > 0").groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("copies"), F.first("bits").alias("bits"))
    return stage(found.withColumn("key", _short(F.col("one"))), "classes")


def similarity_components(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, tree_sets: int = TREE_SETS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id for every row.

    Empty sets (null, empty or blank texts) are linked with nothing. Rows with a null id share the component of equal sets and link
    nothing else. Rows that repeat an id are one document: what any of its texts links with is in its component. Copies
    share one class, so groups of any size cost one row in every join but the last."""
    rows = describe(docs)
    members = set_classes(rows).filter("rep is not null")
    links = similarity_links(docs, rows, members, chunk_tokens, tree_sets)
    mark = F.struct("one", "two", "n")
    several = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("doc_id")
    texts = rows.select("doc_id", "one", "two", "n").join(several, "doc_id").join(members.select("one", "two", "n", "rep"), ["one", "two", "n"])
    joined = stage(components(links.unionByName(texts.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))), "components")
    own = members.select(F.col("one").alias("l_one"), F.col("two").alias("l_two"), F.col("n").alias("l_n"), "rep")
    same = (F.col("one") == F.col("l_one")) & (F.col("two") == F.col("l_two")) & (F.col("n") == F.col("l_n"))
    placed = rows.select("doc_id", "n", "one", "two").join(own, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("home"))
    return placed.join(joined, F.col("home") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "home").alias("component_id"))


def link_counts(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, tree_sets: int = TREE_SETS) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_links for every row: how many other rows with an id link with it, equal texts too.

    Exact: the signature tree of each chunk, and of each two chunks of one cluster, is traversed without leaving out known components.
    A cluster of m sets takes up to m * m / 2 comparisons, and its texts go to as many trees as it has chunks; only sums leave a tree. Empty
    sets have no link. A row with a null id is nobody's partner and, where it equals no row with an id, has none itself (0)."""
    rows = describe(docs)
    members = set_classes(rows).filter("rep is not null")
    dealt = dealt_clusters(docs, rows, members, chunk_tokens, tree_sets)
    ways = F.sequence(F.lit(0), F.col("chunks") - 1)
    pairs = dealt.join(members.select("one", "two", "n", "copies"), ["one", "two", "n"]).select("rep", "one", "two", "copies", "part", "own", F.explode(ways).alias("other"))
    tree = F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other"))
    trees = stage(pairs.select("rep", "one", "two", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("label"), F.col("copies").alias("weight"), tree.alias("tree")), "link-trees")
    far = cluster_weights(docs, trees).groupBy("one", "two").agg(F.sum("linked").alias("linked"))
    counted = members.join(far, ["one", "two"], "left").select("one", "two", "n", (F.col("copies") + F.coalesce("linked", F.lit(0))).alias("reach"))
    own = F.when(F.col("reach").isNull(), 0).otherwise(F.col("reach") - F.col("doc_id").isNotNull().cast("long"))
    return rows.select("doc_id", "one", "two", "n").join(counted, ["one", "two", "n"], "left").select("doc_id", own.cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT * FROM (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a) SELECT * FROM r))
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(reach.b)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
