"""N-gram Jaccard self-join by adaptive multi-match prefixes.

Tokens (5-word shingles) have one global order, from rare to frequent by counts over all
documents in a table of fixed width. Of a document of s tokens the first
s - ceil(t s) + m hold at least m of those that it shares with any document it links to, for
every m; so two documents that link share min(m, m') tokens of their prefixes. Each
document chooses its m: a longer prefix costs tokens read, more matches spare candidates.
The first of the tokens that two linked documents share stands in the prefix for m = 1 of
both; so the tokens of that prefix alone are posted, and a pair that meets there at places
that both sizes allow is a seed. Seeds are then held against the lengthened prefixes, and
those that share as many tokens as these ask for are verified on their whole sets.

Hot groups. Equal sets are one node before anything else. Near copies are first tied to
hub documents (of those with a common min-wise token the one whose tokens are the most frequent, and
so the family's middle; an aggregation that combines before the shuffle), the ties verified, and
components formed. From then on a pair
inside one component needs no test, so postings that stay in one component make no pair,
and a group of copies costs as many tests as it has members. Members of a family that are too
far from its middle to link with most others have few of its tokens early in their order, so
they are not seeds with each of them. Every seed is tested; none is capped or dropped.
Postings of a very frequent token are split into blocks, and every pair of blocks is met once.

Defined results: null and empty texts have an empty set and stay alone; rows that repeat an
id are one node, linked when any of its texts links; a null id is reported with itself as
its component and not joined; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import id_filter
from quillgraph.llm.common import join_counted, materialize, partitions, release_memory, text_runs, utf8_view
from quillgraph.llm.shingles import mix, shingle_sets
from quillgraph.operators.components import connected_components

U = np.uint64
#: log2 of the width of the table of token counts, a fixed size.
WIDTH = 22
#: Steps of the logarithm of a count that the table keeps apart.
STEPS = 16
CHUNKS = 16
#: Independent min-wise tokens by which hubs are found.
HUBS = 6
#: Largest m, and what verifying a candidate costs in postings read.
MOST_MATCHES, VERIFY = 8, 50.0
#: Estimated postings of a token beyond which they are split into blocks; pairs of blocks share the work.
BLOCK = 200_000
#: Members of a hub that are verified in one task.
MEMBERS = 500
#: Pairs of postings that are looked at a time, and postings in a bucket.
PAIRS, BUCKET = 2_000_000, 4_000_000
#: Tables of counts that one task adds.
FAN_IN = 64

_SEEDS = np.random.default_rng(5).integers(0, 2**64, HUBS, dtype=U)


def _profile(size: int):
    """Per document: id, number of shingles, digest of the set, min-wise tokens; per task: counts by table cell."""

    def run(batches):
        table = np.zeros(1 << WIDTH, np.uint32)
        kinds = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("hubs", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])
        for batch in (part for b in batches for part in text_runs(b, 1)):
            n, digest, hubs, seen = [], [], [], []
            for s in shingle_sets(*utf8_view(batch.column(1)), size):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                hubs.append([int(mix(s ^ k).min().view(np.int64)) for k in _SEEDS] if len(s) else [])
                seen.append(s >> U(64 - WIDTH))
            if seen:
                cells, times = np.unique(np.concatenate(seen).astype(np.uint32), return_counts=True)
                table[cells] += np.minimum(times, 2**32 - 1 - table[cells].astype(np.int64)).astype(np.uint32)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(hubs, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], schema=kinds)
        parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(table, CHUNKS)]
        none = pa.nulls(CHUNKS)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()), pa.array([None] * CHUNKS, pa.list_(pa.int64())), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=kinds)
        release_memory()

    return run


def _add_counts(batches):
    """Sum of the tables of each chunk; a task reads FAN_IN tables of a chunk or a few more."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.uint64)
            total[chunk] = total[chunk] + part if chunk in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(np.minimum(v, 2**32 - 1).astype("<u4").tobytes(), 1) for v in total.values()], pa.binary())], names=["chunk", "counts"])


def _passed(bits: np.ndarray):
    """Rows (id, text, place in the filter) that the filter passes."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(id_filter.passes(bits, batch.column(2).to_numpy()))).select(["id", "text"])
        release_memory()

    return run


def _posted_alone(bits: np.ndarray, posted):
    def run(batches):
        rest = (batch.filter(pa.array(~id_filter.passes(bits, batch.column(2).to_numpy()))) for batch in batches)
        yield from posted(pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(0)], names=["id", "text", "component"]) for b in rest)

    return run


def _sets_of(bits: np.ndarray, size: int):
    """Whole sets of the documents that the filter passes, sorted."""

    def run(batches):
        for batch in (part for b in batches for part in text_runs(b, 1)):
            batch = batch.filter(pa.array(id_filter.passes(bits, batch.column(2).to_numpy())))
            sets = [s.tobytes() for s in shingle_sets(*utf8_view(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "tokens"])
        release_memory()

    return run


def _scores(bits: np.ndarray, order: TokenOrder, size: int):
    """How often the tokens of a document are seen, in the mean of logarithms."""

    def run(batches):
        for batch in (part for b in batches for part in text_runs(b, 1)):
            batch = batch.filter(pa.array(id_filter.passes(bits, batch.column(2).to_numpy())))
            score = [int(1000 * order.table[(s >> U(64 - WIDTH)).astype(np.int64)].mean()) if len(s) else None for s in shingle_sets(*utf8_view(batch.column(1)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.int64())], names=["node", "score"])
        release_memory()

    return run


def _prefixes_of(bits: np.ndarray, order: TokenOrder, size: int, num: int, den: int):
    """Lengthened prefixes of the documents that the filter passes: size of the set, m, then tokens in global order."""

    def run(batches):
        for batch in (part for b in batches for part in text_runs(b, 1)):
            batch = batch.filter(pa.array(id_filter.passes(bits, batch.column(2).to_numpy())))
            out = []
            for s in shingle_sets(*utf8_view(batch.column(1)), size):
                n = len(s)
                if not n:
                    out.append(b"")
                    continue
                s, frequency = order.sort(s)
                overlap = -(-num * n // den)
                m = choose_matches(frequency, n, overlap)
                out.append(np.array([n, m], U).tobytes() + s[: n - overlap + m].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "tokens"])
        release_memory()

    return run


def _link(num: int, den: int):
    """Whether two sorted sets link."""

    def test(t: np.ndarray, h: np.ndarray) -> bool:
        small, large = (t, h) if len(t) < len(h) else (h, t)
        if den * len(small) < num * len(large):
            return False
        common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
        return den * common >= num * (len(t) + len(h) - common)

    return test


def _prefixes_match(num: int, den: int):
    """Whether two prefixes share as many tokens as two documents that link must."""

    def test(t: np.ndarray, h: np.ndarray) -> bool:
        (n, m), (k, w) = t[:2].astype(np.int64), h[:2].astype(np.int64)
        overlap, need = -(-num * (n + k) // (num + den)), min(m, w)
        if overlap > min(n, k):
            return False
        # The pair shares `overlap` tokens, so `need` of them stand this early in both.
        return len(np.intersect1d(t[2 : 2 + n - overlap + need], h[2 : 2 + k - overlap + need], assume_unique=True)) >= need

    return test


def _verify(test):
    """Rows (a, salt, b or null for a itself, tokens) with a's own first: the pairs (a, b) that pass the test."""

    def run(batches):
        key, heads = None, []
        for batch in batches:
            a, salt, b, tokens = (batch.column(i) for i in range(4))
            found = [[], []]
            for i, (x, s, y) in enumerate(zip(a.to_pylist(), salt.to_pylist(), b.to_pylist())):
                if (x, s) != key:
                    key, heads = (x, s), []
                t = np.frombuffer(tokens[i].as_buffer(), U)
                if y is None:
                    heads.append(t.copy())
                elif any(test(t, h) for h in heads):
                    found[0].append(x), found[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["a", "b"])
        release_memory()

    return run


class TokenOrder:
    """The global order of tokens: by counts in a table of fixed width, equal ones by their hashes."""

    def __init__(self, counted: np.ndarray):
        self.table = np.round(STEPS * np.log2(np.maximum(counted, 1))).astype(np.uint16)
        self.usual = float(counted.mean())  # what other tokens add to a cell
        self.count_of = 2.0 ** (np.arange(32 * STEPS + 1) / STEPS)

    def sort(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted set in global order, and estimated counts of its tokens."""
        seen = self.table[(s >> U(64 - WIDTH)).astype(np.int64)]
        at = np.argsort(seen, kind="stable")
        return s[at], np.maximum(self.count_of[seen[at]] - self.usual, 1.0)


class JaccardJoin:
    """One self-join: documents (id, text), shingles of `size` words, links from num/den of the union on."""

    def __init__(self, docs: DataFrame, size: int = 5, num: int = 75, den: int = 100):
        self.rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
        self.spark, self.size, self.num, self.den = docs.sparkSession, size, num, den

    def profile(self) -> None:
        table = materialize(self.rows.mapInArrow(_profile(self.size), "id long, n long, digest string, hubs array<long>, chunk int, counts binary"), "profiles")
        self.docs = table.where("chunk IS NULL").select("id", "n", "digest", "hubs")
        self.order = TokenOrder(self.token_counts(table.where("chunk IS NOT NULL").select("chunk", "counts")))
        usable = self.docs.where("n > 0 AND id IS NOT NULL")
        self.nodes = materialize(usable.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("hubs").alias("hubs")), "nodes")
        posted = self.nodes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * self.num / self.den) + 1)).first()[0] or 0
        self.buckets = max(1, partitions(self.spark), -(-int(posted) // BUCKET))

    def token_counts(self, counts: DataFrame) -> np.ndarray:
        """Sum of all tasks' tables, FAN_IN at a time until one of each chunk is left."""
        left = -(-counts.count() // CHUNKS)
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            dealt = counts.withColumn("at", F.pmod(F.xxhash64("chunk", F.monotonically_increasing_id()), F.lit(left)))
            counts = materialize(dealt.repartition(CHUNKS * left, "chunk", "at").select("chunk", "counts").mapInArrow(_add_counts, "chunk int, counts binary"), "token-counts")
        added = counts.repartition(CHUNKS, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").orderBy("chunk").collect()  # fixed size
        return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), "<u4") for r in added]) if added else np.zeros(1 << WIDTH, np.uint32)

    def _passing(self, pairs: DataFrame, payload, test, name: str) -> DataFrame:
        """The pairs (a, b) whose payloads, made from the texts of ids in the pairs, pass the test. Partners of an id are salted."""
        if not pairs.limit(1).count():
            return pairs
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        bits = id_filter.build(ids, "id")
        rows = self.rows.where("id IS NOT NULL").withColumn("at", id_filter.place("id"))
        made = rows.mapInArrow(payload(bits), "id long, tokens binary").where(F.length("tokens") > 0)
        many = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "salts")
        salted = pairs.join(many.where("salts > 1"), "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0)).cast("int"))
        heads = many.select(F.col("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        wanted = salted.select("a", "salt", "b", F.col("b").alias("id")).unionByName(heads.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("id")))
        rows = wanted.join(made, "id").select("a", "salt", "b", "tokens")
        n = max(1, partitions(self.spark))
        ordered = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return materialize(ordered.mapInArrow(_verify(test), "a long, b long").distinct(), name)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets link."""
        return self._passing(materialize(pairs, "pairs"), lambda bits: _sets_of(bits, self.size), _link(self.num, self.den), "links")

    def hub_pairs(self) -> DataFrame:
        """Each node with the most central of the nodes that have the same min-wise token, for each of HUBS kinds of tokens.

        A node is the more central the more often its tokens are seen in all documents: few of them are its own.
        """
        tokens = self.nodes.select("node", F.posexplode("hubs").alias("kind", "token"))
        keys = ["kind", "token"]
        crowds = materialize(tokens.groupBy(*keys).agg(F.count("*").alias("many")).where("many > 1"), "crowds")
        met = materialize(join_counted(tokens, crowds, keys, "many"), "crowded")
        if not met.limit(1).count():
            return met.select(F.col("node").alias("a"), F.col("node").alias("b"))
        bits = id_filter.build(met.select("node"), "node")
        rows = self.rows.where("id IS NOT NULL").withColumn("at", id_filter.place("id"))
        scores = rows.mapInArrow(_scores(bits, self.order, self.size), "node long, score long").groupBy("node").agg(F.max("score").alias("score"))
        hubs = met.join(scores, "node").groupBy(*keys).agg(F.max(F.struct("score", (-F.col("node")).alias("low")))["low"].alias("low"), F.count("*").alias("many"))
        hubs = materialize(hubs.select(*keys, "many", (-F.col("low")).alias("hub")), "hubs")
        pairs = join_counted(met, hubs, keys, "many", "hub").where("node <> hub")
        return pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    def shared_ids(self) -> DataFrame:
        """Edges between the nodes of the texts of one id, where an id repeats with several texts."""
        texts = self.docs.where("n > 0 AND id IS NOT NULL").select("id", "digest").distinct()
        several = texts.groupBy("id").count().where("count > 1").select("id")
        nodes = texts.join(several, "id").join(self.nodes.select("digest", "node"), "digest").select("id", "node")
        low = nodes.groupBy("id").agg(F.min("node").alias("a"))
        return nodes.join(low, "id").where("a <> node").select("a", F.col("node").alias("b")).distinct()

    def postings(self, components: DataFrame) -> DataFrame:
        """Tokens of the shortest prefix of one text of each node, packed by bucket and batch."""
        named = self.nodes.select("digest", "node").join(components.select("node", "component"), "node", "left")
        named = named.select(F.col("node").alias("id"), "digest", F.coalesce("component", "node").alias("component"))
        # The text of a node is that of its smallest id; ids of other rows find no partner.
        keyed = self.docs.where("n > 0").select("id", "digest").distinct().join(named, ["id", "digest"], "left").select("id", "component")
        keyed = materialize(keyed.groupBy("id").agg(F.min("component").alias("component")), "node-components")
        bits = id_filter.build(keyed.where("component IS NULL OR component <> id"), "id")
        rows = self.rows.where("id IS NOT NULL").withColumn("at", id_filter.place("id"))
        posted = _postings(self.order, self.buckets, self.size, self.num, self.den)
        alone = rows.mapInArrow(_posted_alone(bits, posted), POSTINGS)  # the filter holds no such id: a node that is its own component
        others = rows.mapInArrow(_passed(bits), "id long, text string").join(keyed.where("component IS NOT NULL"), "id").select("id", "text", "component")
        return alone.unionByName(others.mapInArrow(posted, POSTINGS))

    def candidate_pairs(self, components: DataFrame) -> DataFrame:
        """Seeds whose lengthened prefixes share enough tokens."""
        seeds = self.postings(components).repartitionById(self.buckets, "bucket").mapInArrow(_seeds(self.num, self.den), "a long, b long")
        prefixes = lambda bits: _prefixes_of(bits, self.order, self.size, self.num, self.den)
        return self._passing(materialize(seeds.distinct(), "seeds"), prefixes, _prefixes_match(self.num, self.den), "candidates")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        self.profile()
        ties = materialize(self.verified(self.hub_pairs()).unionByName(self.shared_ids()), "ties")
        components = materialize(connected_components(ties), "hub-components")
        links = self.verified(self.candidate_pairs(components))
        joined = connected_components(ties.unionByName(links))
        named = self.nodes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
        rows = materialize(self.docs.join(named, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component")), "row-components")
        # All rows of an id are one node, those without a word too.
        torn = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("id", "low")
        return rows.join(torn, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "component")).alias("component_id"))


POSTINGS = "bucket int, tokens binary, sides binary, places binary, owners binary, ids binary, components binary, sizes binary"


def choose_matches(frequency: np.ndarray, size: int, overlap: int) -> int:
    """m of the least estimated cost. frequency: of the document's tokens in global order, rarest first."""
    ms = np.arange(1, min(MOST_MATCHES, overlap) + 1)
    scanned = np.cumsum(frequency)[size - overlap + ms - 1]
    return int(ms[np.argmin(scanned * (1 + VERIFY / ms.astype(float) ** 2))])


def _postings(order: TokenOrder, buckets: int, size: int, num: int, den: int):
    def run(batches):
        for batch in (part for b in batches for part in text_runs(b, 1, 1 << 24)):
            ids, components = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            tokens, owner, side, place, sizes = [], [], [], [], []
            for k, s in enumerate(shingle_sets(*utf8_view(batch.column(1)), size)):
                n = len(s)
                sizes.append(n)
                if not n:
                    continue
                s, frequency = order.sort(s)
                last = n - -(-num * n // den) + 1
                blocks = np.ceil(frequency[:last] / BLOCK).astype(np.int64)
                one = blocks == 1
                tokens.append(s[:last][one])
                owner.append(np.full(int(one.sum()), k))
                side.append(np.full(int(one.sum()), 2, np.uint8))
                place.append(np.flatnonzero(one))
                for t, many, p in zip(s[:last][~one], blocks[~one], np.flatnonzero(~one)):
                    own = int(mix(np.array([ids[k]], np.int64).view(U) ^ t)[0] % U(many))
                    other = np.arange(many)
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    tokens.append(mix(t + (low * many + high).astype(U) * U(0x9E3779B97F4A7C15)))
                    owner.append(np.full(many, k))
                    place.append(np.full(many, p))
                    side.append(np.where(other == own, 2, (own > other).astype(np.uint8)).astype(np.uint8))
            if not tokens:
                continue
            tokens, owner, side, place = np.concatenate(tokens), np.concatenate(owner), np.concatenate(side), np.concatenate(place)
            place = np.where(place < 1 << 16, place, 0).astype(np.uint16)  # a place too far to be kept passes every test
            sizes = np.array(sizes, np.int32)
            bucket = (tokens % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[by], return_index=True)
            out = [[] for _ in range(8)]
            for b, at in zip(used.tolist(), np.split(by, first[1:])):
                who, local = np.unique(owner[at], return_inverse=True)
                short = (tokens[at] // U(buckets)).astype(np.uint32)  # a rare clash only adds a seed
                for column, v in zip(out, (b, short.tobytes(), side[at].tobytes(), place[at].tobytes(), local.astype(np.uint16).tobytes(), ids[who].tobytes(), components[who].tobytes(), sizes[who].tobytes())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=["bucket", "tokens", "sides", "places", "owners", "ids", "components", "sizes"])
        release_memory()

    return run


def _seeds(num: int, den: int):
    """All pairs of a bucket's documents that share a token early enough in both, lie in different components and can be alike in size."""

    def run(batches):
        parts: list[tuple] = []
        docs = 0
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda i, t: np.frombuffer(batch.column(i)[row].as_buffer(), t)  # noqa: B023,E731
                part = (get(1, np.uint32).copy(), get(2, np.uint8).copy(), get(3, np.uint16).copy(), get(4, np.uint16).astype(np.uint32) + np.uint32(docs), get(5, np.int64).copy(), get(6, np.int64).copy(), get(7, np.int32).copy())
                docs += len(part[4])
                parts.append(part)
        if not parts:
            return
        tokens, side, place, owner, ids, component, sizes = (np.concatenate([p[i] for p in parts]) for i in range(7))
        parts.clear()
        yield from _seed_pairs(tokens, side, place, owner, ids, component, sizes, num, den)
        release_memory()

    return run


def _seed_pairs(tokens, side, place, owner, ids, component, sizes, num, den):
    """Postings of one bucket: its seeds, once each."""
    # Before a posting at place p stand p tokens that the pair does not share, so at most s - p are
    # shared, and the partner is no larger than `most`. What no partner in its run can meet goes.
    size = sizes.astype(np.int64)[owner]
    most = (num + den) * (size - place.astype(np.int64)) // num - size
    order = np.argsort(tokens, kind="stable")
    run = np.cumsum(np.concatenate([[False], tokens[order][1:] != tokens[order][:-1]]))
    first = np.flatnonzero(np.diff(run, prepend=-1))
    least = np.minimum.reduceat(size[order], first)[run]
    left = order[(np.diff(np.append(first, len(order)))[run] > 1) & (most[order] >= least)]
    tokens, side, owner, size, most = tokens[left], side[left], owner[left], size[left], most[left]
    if not len(tokens):
        return
    order = np.lexsort((component[owner], tokens))
    tokens, side, owner, size, most = tokens[order], side[order], owner[order].astype(np.int64), size[order], most[order]
    comp = component[owner]
    new_run = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    run_end = np.append(np.flatnonzero(new_run)[1:], len(tokens))[np.cumsum(new_run) - 1]
    new_comp = new_run | np.concatenate([[True], comp[1:] != comp[:-1]])
    comp_end = np.append(np.flatnonzero(new_comp)[1:], len(tokens))[np.cumsum(new_comp) - 1]
    partners = run_end - comp_end
    some = np.flatnonzero(partners)
    total = np.concatenate([[0], np.cumsum(partners[some])])
    codes, first, n = np.zeros(0, np.int64), 0, len(ids)
    while first < len(some):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1)
        who, many = some[first:last], partners[some[first:last]]
        left = np.repeat(who, many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(comp_end[who], many)
        alike = (size[left] <= most[right]) & (size[right] <= most[left])
        alike &= den * np.minimum(size[left], size[right]) >= num * np.maximum(size[left], size[right])
        alike &= (side[left] == 2) | (side[left] != side[right])
        a, b = owner[left[alike]], owner[right[alike]]
        codes = np.union1d(codes, np.minimum(a, b) * n + np.maximum(a, b))
        first = last
    for i in range(0, len(codes), 50_000):
        a, b = ids[codes[i : i + 50_000] // n], ids[codes[i : i + 50_000] % n]
        apart = a != b
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[apart]), pa.array(np.maximum(a, b)[apart])], names=["a", "b"])


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: links between documents whose shingle sets meet num/den of their union."""
    return JaccardJoin(docs, size, num, den).run()
