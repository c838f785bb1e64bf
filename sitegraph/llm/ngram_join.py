"""Operator 2: n-gram Jaccard self-join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct ``shingle``-word runs. Two sets link when
``100 * |both| >= percent * |either|``. Work is done per distinct set (exact copies share one node), as follows.

1. Classes. Shingles in a hash-ordered prefix of every set are counted over all documents, and all others of the sets
   that lack rare ones there. Those in more than ``FREQUENT`` documents form the frequent class, kept as a fixed-size bitmap (a false mark only moves a shingle
   to the frequent class, which is consistent for all documents and so costs no link).
2. Prefixes. All sets are ordered by (class, hash), rare first. With at most ``e`` shingles of a set missing in a
   partner, a prefix covers a link if its coverage exceeds ``e``: a rare shingle covers 1 and is a signature by
   itself; frequent shingles are dealt into cells by hash, a cell with ``c`` of them covers ``c - 1``, and each pair
   in a cell is a signature. Losing a shingle loses at most 1 of coverage, so a linked pair shares a signature. The
   number of cells follows the size class (factors of 100/percent), and sets sign for their own class and the next,
   so any two sets that can link sign alike once.
3. Candidates. Small signature groups give all their pairs. Large groups of nearly the same members (equal under two
   minimum hashes) become one, so members that share many signatures meet about once. In a large group one hub meets
   all others; while a group has members of several components, more hubs follow (``WIDTH`` times as many each round),
   until all members that are no hubs lie in one component. So no link between components is lost and no group is
   squared when its members link with each other.
4. Verification. A parity bitmap of each set bounds the symmetric difference from below and drops most false
   candidates (of large groups in the join itself, on bitmaps folded to ``LANES`` longs); the rest meet with their
   whole sets.
5. Components of the verified links; a document's component is named by its least doc_id.

6. All links, on request. A link lies within a component. A component of two sets is one link; the sets of a larger one
   are dealt into blocks by hash (about ``BLOCK`` sets or ``BLOCK_TOKENS`` shingles), and every two blocks meet in a cell with their whole sets. A set
   is sent once per block of its component. This work grows with the square of a component, as its links can.

Signatures, candidates and links are written tables. Nothing that grows with the data is collected or broadcast.
Set identity uses 64-bit hashes: a wrong link needs colliding shingles inside one candidate pair.

Defined results: without words (null, empty, white space) a document has size 0 and is its own component; rows that
repeat a doc_id are treated as documents of their own that share its name; a null doc_id names a component only if
no member has another; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.group import GroupedData

from sitegraph.llm.common import Words, bitmap, discard, marked, mix, saved, signed, slices, small_batches
from sitegraph.llm.components import components
from sitegraph.plans.tables import table

SHINGLE, PERCENT = 5, 80
BLOCK, BLOCK_TOKENS, COLUMNS = 128, 1 << 20, 8192
NO_ID = -1  # stands for a null id in the bitmap of sets; an id of -1 only marks more
FREQUENT, SMALL_GROUP, WIDTH, LANES = 16, 16, 16, 16
WORDS = Words(bytes(b for b in range(256) if b != 32 and not 9 <= b <= 13))
ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, words = WORDS(texts)
    runs = np.zeros(max(0, len(words) - shingle + 1), np.uint64)
    for j in range(shingle if len(runs) else 0):
        runs += words[j:j + len(runs)] * ODD[j]
    runs = mix(runs)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(runs[a:b - shingle + 1]))
        elif b > a:
            out.append(mix((words[a:b] * ODD[:b - a]).sum(dtype=np.uint64, keepdims=True) + ODD[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def errors(n: int, percent: int) -> int:
    """How many of a set's ``n`` shingles a partner can lack."""
    return n - -(-percent * n // 100)


def size_classes(percent: int) -> np.ndarray:
    """The least size of each class; sizes of linked sets lie in the same class or in neighbours."""
    out, s = [], 0
    while (least := -(-100 ** s // percent ** s)) < 1 << 40:
        out.append(least)
        s += 1
    return np.array(out, np.int64)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set, given which of its shingles are frequent: single rare shingles, and pairs of frequent
    ones. If there are pairs, the singles are all of the set's rare shingles."""
    n = len(s)
    need = errors(n, percent) + 1
    rare = s[~frequent][:need]
    out, common = [np.zeros(0, np.uint64)], s[frequent]
    if len(rare) == need:
        return rare, out[0]
    own = int(np.searchsorted(classes, n, "right")) - 1
    for scheme in (own, own + 1):
        cells = max(1, int(classes[scheme - 1]) // 8) if scheme else 1
        cell = mix(common ^ ODD[40]) % np.uint64(cells)
        first = np.zeros(len(common), np.int64)
        first[np.unique(cell, return_index=True)[1]] = 1
        covered = np.cumsum(1 - first)
        take = int(np.searchsorted(covered, need - len(rare))) + 1
        order = np.argsort(cell[:take], kind="stable")
        tokens, cell = common[:take][order], cell[:take][order]
        for lag in range(1, take):
            same = cell[lag:] == cell[:-lag]
            if not same.any():
                break
            out.append(mix(tokens[:-lag][same] * ODD[41] + tokens[lag:][same] * ODD[42] + ODD[scheme % 32]))
    return rare, np.unique(np.concatenate(out))


def parity(s: np.ndarray) -> bytes:
    """Per place of a bitmap with at least as many places as members: the parity of the members there."""
    places = max(64 * LANES, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount(((s >> np.uint64(17)) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their parity bitmaps."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        if len(x) < len(y):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        else:
            x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _counted(shingle: int, percent: int, shared=None) -> Callable:
    """The shingles to count: a little more than each set's plain prefix. With the frequent ones of these, the other
    shingles of the sets whose prefix must go on beyond what was counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            parts = []
            for s in shingle_sets(texts, shingle):
                need = errors(len(s), percent) + 1
                counted = need + len(s) // 14
                if not shared:
                    parts.append(s[:counted])
                elif len(s) > counted and np.count_nonzero(~marked(shared.value, s[:counted])) < need:
                    parts.append(s[counted:])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(parts)))], names=["token"])
    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parity bitmaps folded to ``LANES`` longs."""
    for batch in batches:
        rows = [np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, LANES)) if x else np.zeros(LANES, np.int64) for x in batch.column("bits").to_pylist()]
        lanes = np.array(rows, np.int64).reshape(-1, LANES)
        yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(lanes[:, i]) for i in range(LANES)]], names=["node", *FOLDED])


FOLDED = [f"p{i}" for i in range(LANES)]
FEATURES = "doc_id long, node long, n long, rare long, sigs array<long>, bits binary"


def _features(shingle: int, percent: int, shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(percent)
        for batch, texts in slices(batches):
            nodes, sizes, rare, sigs, bits = [], [], [], [], []
            for s in shingle_sets(texts, shingle):
                n = len(s)
                nodes.append(node_of(s) if n else None)
                sizes.append(n)
                singles, pairs = signatures(s, marked(shared.value, s), percent, classes) if n > 1 else (s[:0], s[:0])
                rare.append(len(singles))
                sigs.append(signed(np.concatenate([singles, pairs])))
                bits.append(parity(s) if n > 1 else None)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rare, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs))), pa.array(bits, pa.binary())],
                names=["doc_id", "node", "n", "rare", "sigs", "bits"])
    return run


def _members(shared) -> Callable:
    """(sig, node, n, rare, single) of the signatures that the bitmap marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("sigs")
            flat = column.flatten().to_numpy()
            offsets, rare = column.offsets.to_numpy(), batch.column("rare").to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            keep = marked(shared.value, flat.view(np.uint64))
            single = (np.arange(len(flat)) + offsets[0] - offsets[rows] < rare[rows])[keep]
            rows = pa.array(rows[keep])
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), *[batch.column(c).take(rows) for c in ("node", "n", "rare")], pa.array(single)],
                                             names=["sig", "node", "n", "rare", "single"])
    return run


def _near(percent: int) -> Callable:
    """The candidate pairs that the parity bitmaps leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("na", "nb", "bits_a", "bits_b")}
            # |both| >= p/(100+p) (na+nb), so the difference is at most (100-p)/(100+p) (na+nb)
            keep = [least_difference(x, y) * (100 + percent) <= (100 - percent) * (m + n) for m, n, x, y in zip(c["na"], c["nb"], c["bits_a"], c["bits_b"])]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep, pa.bool_()))
    return run


def _sets(shingle: int, shared) -> Callable:
    """The whole sets of the documents that the bitmap of (node, doc_id) marks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that repeat a doc_id and its set, or share the null id, count once a task
        for batch, texts in slices(batches):
            nodes, sets = [], []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts, shingle)):
                if len(s):
                    node = node_of(s)
                    place = _place(node, NO_ID if doc_id is None else doc_id)
                    if node not in seen and marked(shared.value, np.array([place], np.int64).view(np.uint64))[0]:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(signed(s))
            if nodes:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["node", "tokens"])
    return run


def _cell_links(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of a cell, and the places ``a < b`` of those that link: of its two blocks with each other, or of its
    only block."""
    nodes, where = np.unique(cell.column("node").to_numpy(), return_index=True)
    cell = cell.take(pa.array(where)).combine_chunks()
    block, tokens = cell.column("block").to_numpy(), cell.column("tokens").combine_chunks()
    sizes = np.diff(tokens.offsets.to_numpy())
    _, token, count = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(nodes)), sizes), count[token] > 1
    place = np.cumsum(count > 1) - 1
    row, token = row[shared], place[token[shared]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    common = np.zeros((len(nodes), len(nodes)))
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        lo, hi = np.searchsorted(token, (at, at + COLUMNS))
        part = np.zeros((len(nodes), COLUMNS), np.float32)
        part[row[lo:hi], token[lo:hi] - at] = 1
        common += part @ part.T
    links = common * (100 + percent) >= (sizes[:, None] + sizes[None, :]) * percent
    if cell.column("i")[0].as_py() != cell.column("j")[0].as_py():
        links &= block[:, None] != block[None, :]
    return nodes, *np.nonzero(np.triu(links, 1))


def _cell(percent: int) -> Callable:
    """The pairs ``a < b`` of a cell that link."""
    def run(cell: pa.Table) -> pa.Table:
        nodes, a, b = _cell_links(cell, percent)
        return pa.table({"a": nodes[a], "b": nodes[b]})
    return run


def _cell_counts(percent: int) -> Callable:
    """The nodes of a cell with the number of their links there: a row a node, however many links it has."""
    def run(cell: pa.Table) -> pa.Table:
        nodes, a, b = _cell_links(cell, percent)
        links = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes))
        return pa.table({"node": nodes[links > 0], "links": links[links > 0]})
    return run


def _place(node: int, doc_id: int) -> int:
    """As ``node ^ doc_id ^ (doc_id << 13)`` on 64 bits."""
    return ((node ^ doc_id ^ (doc_id << 13)) + (1 << 63)) % (1 << 64) - (1 << 63)


class Join:
    """One self-join over ``docs``."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int):
        self.docs, self.shingle, self.percent = docs.select("doc_id", "text"), shingle, percent
        self.shared: list = []
        small_batches(docs.sparkSession)

    def broadcast(self, value):
        """A broadcast that lives until ``written``."""
        self.shared.append(self.docs.sparkSession.sparkContext.broadcast(value))
        return self.shared[-1]

    def written(self, made):
        """``made`` (a written table or a value), without the broadcasts it was made with."""
        while self.shared:
            self.shared.pop().destroy()
        return made

    def classes(self) -> DataFrame:
        """``doc_id, node, n`` and the signatures of every row."""
        def frequent(shared=None) -> np.ndarray:
            tokens = self.docs.mapInArrow(_counted(self.shingle, self.percent, shared), "token long")
            return bitmap(tokens.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > FREQUENT), F.col("token"))

        first = frequent()
        both = first | self.written(frequent(self.broadcast(first)))
        return self.written(saved(self.docs.mapInArrow(_features(self.shingle, self.percent, self.broadcast(both)), FEATURES), "features"))

    def members(self, features: DataFrame) -> DataFrame:
        """``sig, node, n, size, own, degree``: the members of every signature of several nodes.

        ``own`` counts shingles that no partner of the group has. In a group of a pair signature every member signs
        with all its rare shingles, so a rare shingle that no other node signs with is in none of them. ``degree`` is
        the number of a node's groups: the members that most others resemble are in the most."""
        shared = features.select("node", F.explode("sigs").alias("sig")).groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
        rows = features.where("node is not null").select("node", "n", "rare", "sigs").mapInArrow(
            _members(self.broadcast(bitmap(shared, F.col("sig")))), "sig long, node long, n long, rare long, single boolean")
        rows = self.written(saved(rows.distinct(), "members"))
        groups = rows.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
        rows, before = saved(rows.join(groups, "sig"), "groups"), rows
        discard(before)
        known = rows.groupBy("node").agg(F.count("*").alias("degree"), F.count_if("single").alias("met"))
        own = F.when(F.col("single"), F.lit(0)).otherwise(F.col("rare") - F.col("met"))
        out = saved(rows.join(known, "node").select("sig", "node", "n", "size", own.alias("own"), "degree"), "all-members")
        discard(rows)
        return out

    def alike(self, a: str, b: str):
        """Whether two members can link by their sizes and by the shingles that only they have. With ``common``
        shingles they link if ``(100 + p) common >= p (na + nb)``, and ``common <= n - own`` on either side."""
        na, nb = F.col(f"n{a}"), F.col(f"n{b}")
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * self.percent) & (
            F.least(na - F.col(f"own{a}"), nb - F.col(f"own{b}")) * (100 + self.percent) >= (na + nb) * self.percent)

    def near(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs ``a, b, na, nb`` that the parity bitmaps leave."""
        a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        met = pairs.select("a", "b").join(a, "a").join(b, "b")
        return saved(met.mapInArrow(_near(self.percent), "a long, b long, na long, nb long"), "near")

    def sets(self, some: DataFrame, nodes: DataFrame) -> DataFrame:
        """``node, tokens``: the whole sets of (at least) ``some`` nodes."""
        lead = F.coalesce("lead", F.lit(NO_ID).cast("long"))  # null if no row of the set has an id
        place = F.col("node").bitwiseXOR(lead).bitwiseXOR(F.shiftleft(lead, 13))
        wanted = bitmap(some.distinct().join(nodes.select("node", "lead"), "node"), place)
        return self.written(saved(self.docs.mapInArrow(_sets(self.shingle, self.broadcast(wanted)), "node long, tokens array<long>"), "sets"))

    def linked(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that link."""
        both = near.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        common = F.size(F.array_intersect("ta", "tb"))
        return both.where(common * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent).select("a", "b").distinct()

    def links(self, features: DataFrame, nodes: DataFrame) -> DataFrame:
        """``node, component`` of the nodes that link with another."""
        members = self.members(features)
        few = members.where(F.col("size") <= SMALL_GROUP)
        side = lambda x: few.select("sig", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("own").alias(f"own{x}"))
        pairs = side("a").join(side("b"), "sig").where(F.col("a") < F.col("b")).where(self.alike("a", "b")).select("a", "b")
        starts = size_classes(self.percent).tolist()
        own = F.size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda x: x <= F.col("n"))) - 1
        many = members.where(F.col("size") > SMALL_GROUP).withColumn("c", own)
        many = self.merged(many.select("sig", F.explode(F.array("c", F.col("c") + 1)).alias("cls"), "node", "n", "own", "degree"), nodes)
        hubs = many.groupBy("sig", "cls").agg(F.max_by(F.struct("node", "n", "own", *FOLDED), F.struct("degree", F.xxhash64("node"), "node")).alias("h"))
        hubs = saved(hubs.select("sig", "cls", "h.*"), "hubs")
        tested = saved(pairs.unionByName(self.met(hubs, many)).distinct(), "pairs")
        discard(members)
        near = self.near(tested, nodes)
        sets = self.sets(near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many.select("node")), nodes)
        links = saved(self.linked(near, sets), "links")
        discard(near)
        self.whole, self.sizes = sets, nodes.select("node", "n")
        found = saved(components(links), "components")
        used, width = hubs.select("sig", "cls", "node").limit(0), WIDTH
        while True:
            placed = many.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            counts = placed.groupBy("sig", "cls", "component").agg(F.count("*").alias("size"))
            most = counts.groupBy("sig", "cls").agg(F.max_by("component", F.struct("size", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
            placed = saved(placed.join(most, ["sig", "cls"]), "open-groups")
            left = placed.where("component <> most").join(used, ["sig", "cls", "node"], "left_anti")
            left = saved(left, "outsiders")
            number = left.groupBy("sig", "cls").agg(F.count("*").alias("left"), F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("least"))
            hubs = left.join(number, ["sig", "cls"]).where(F.col("node").eqNullSafe(F.col("least")) | (F.pmod(F.xxhash64("node"), F.col("left")) < width)).select("sig", "cls", "node", "n", "own", "component", *FOLDED)
            if left.isEmpty():
                discard(many, placed, left)
                return found
            hubs = saved(hubs, "hubs")
            new = saved(self.met(hubs, placed, True).join(tested, ["a", "b"], "left_anti"), "pairs")
            discard(placed, left)
            near = self.near(new, nodes)
            tested, used, width = tested.unionByName(new), used.unionByName(hubs.select("sig", "cls", "node")), width * WIDTH
            if not near.isEmpty():
                more = saved(self.linked(near, sets), "links")
                if not more.isEmpty():
                    links = links.unionByName(more)
                    found = saved(components(links), "components")

    def merged(self, many: DataFrame, nodes: DataFrame) -> DataFrame:
        """The large groups with those of nearly the same members made one (``sig`` names the new group), and the folded
        parities of the members. Groups with the same least member under two hashes are united, which keeps every pair
        of members. ``own`` is the least of a member's: two members that link share a group, where it holds for both."""
        many = saved(many, "large-groups")
        least = many.groupBy("sig", "cls").agg(F.xxhash64(F.min(F.xxhash64("node")), F.min(F.xxhash64(F.lit(1), "node"))).alias("to"), F.count("*").alias("size")).where("size > 1")
        rows = many.join(least, ["sig", "cls"]).groupBy(F.col("to").alias("sig"), "cls", "node").agg(F.first("n").alias("n"), F.min("own").alias("own"), F.max("degree").alias("degree"))
        folded = many.select("node").distinct().join(nodes.select("node", "bits"), "node").mapInArrow(_folded, ", ".join(f"{c} long" for c in ["node", *FOLDED]))
        out = saved(rows.join(folded, "node"), "merged-groups")
        discard(many)
        return out

    def met(self, hubs: DataFrame, members: DataFrame, apart: bool = False) -> DataFrame:
        """Hubs with the other members of their groups (``apart``: of other components), as pairs ``a < b``."""
        h = hubs.select("sig", "cls", F.col("node").alias("hub"), F.col("n").alias("nh"), F.col("own").alias("ownh"), *[F.col(p).alias(f"h{p}") for p in FOLDED], *([F.col("component").alias("ch")] if apart else []))
        m = members.select("sig", "cls", "node", F.col("n").alias("nm"), F.col("own").alias("ownm"), *FOLDED, *(["component"] if apart else []))
        # the same bound as in _near: |both| >= p/(100+p) (na+nb) leaves a difference of at most (100-p)/(100+p) (na+nb)
        differ = reduce(add, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"h{p}"))) for p in FOLDED])
        close = differ * (100 + self.percent) <= (F.col("nh") + F.col("nm")) * (100 - self.percent)
        met = m.join(h, ["sig", "cls"]).where("hub <> node").where(self.alike("h", "m")).where(close)
        if apart:
            met = met.where("component <> ch")
        return met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    def cells(self, found: DataFrame) -> tuple[DataFrame, GroupedData]:
        """The members of components of two sets, and those of larger ones in cells, given the components that ``links``
        found. A link lies within a component, so a component's members meet in blocks: a set is sent once per block of
        its own component, and every pair meets in one cell."""
        placed = found.join(self.sizes, "node")
        sizes = placed.groupBy("component").agg(F.count("*").alias("m"), F.max("n").alias("most"))
        members = placed.join(sizes, "component").select("node", "component", "m", "most")
        blocks = F.ceil(F.col("m") / F.expr(f"greatest(2, least({BLOCK}, {BLOCK_TOKENS} div most))")).cast("int")
        dealt = members.where("m > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = dealt.select("component", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return members.where("m = 2").select("node", "component"), dealt.join(self.whole, "node").groupBy("component", "i", "j")

    def all_links(self, found: DataFrame) -> DataFrame:
        """All links ``a < b`` between distinct sets, given the components that ``links`` found."""
        two, cells = self.cells(found)
        two = two.groupBy("component").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
        return saved(two.unionByName(cells.applyInArrow(_cell(self.percent), "a long, b long")).distinct(), "all-links")

    def link_counts(self, found: DataFrame) -> DataFrame:
        """``node, n_links`` of the nodes that link with another, given the components that ``links`` found. Links are
        counted in their cells, so none of them becomes a row."""
        two, cells = self.cells(found)
        counts = two.select("node", F.lit(1).cast("long").alias("links")).unionByName(cells.applyInArrow(_cell_counts(self.percent), "node long, links long"))
        return saved(counts.groupBy("node").agg(F.sum("links").alias("n_links")), "link-counts")

    def run(self, count: bool = False) -> DataFrame:
        """``doc_id, n_shingles, component_id, set_id, component``: the last two name the distinct set and the
        component by a set's hash (null without words), whatever the doc_ids. With ``count`` also ``n_links``: the
        number of other distinct sets that the document's set links with."""
        features = self.classes()
        nodes = features.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("lead"), F.first("n").alias("n"), F.first("bits").alias("bits"))
        nodes = saved(nodes, "nodes")
        found = self.links(features, nodes)
        placed = nodes.select("node", "lead").join(found, "node", "left").select("node", "lead", F.coalesce("component", "node").alias("component"))
        names = placed.groupBy("component").agg(F.min("lead").alias("component_id"))
        named = saved(placed.join(names, "component").select("node", "component", "component_id"), "named")
        rows, more = features.select("doc_id", "n", "node").join(named, "node", "left"), []
        if count:
            rows = rows.join(self.link_counts(found), "node", "left")
            more = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")]
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                           F.col("node").alias("set_id"), "component", *more)


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, count: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, set_id, component`` (and ``n_links`` with ``count``)."""
    return Join(docs, shingle, percent).run(count)


def document_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """All links between distinct sets, ``a < b`` by the ``set_id`` of ``similar_documents``."""
    join = Join(docs, shingle, percent)
    features = join.classes()
    nodes = features.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("lead"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    return join.all_links(join.links(features, saved(nodes, "nodes")))


def without_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` (same columns) with one row of each component: of its least doc_id (a null id is the last), and of
    that id the least set. Rows without words stay.

    Members of groups are few beside the other rows: a bitmap of their ids (fixed size) splits the table, and only
    the part it marks is joined and shuffled.
    """
    tag = "__copies_"
    while any(c.startswith(tag) for c in docs.columns):
        tag = f"_{tag}"
    doc_key, set_key, stays, hash_key = (f"{tag}{x}" for x in ("doc", "set", "stays", "hash"))
    found = saved(similar_documents(docs, shingle, percent).where("set_id is not null").select("doc_id", "set_id", "component"), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "set_id")).alias("first")
    groups = found.groupBy("component").agg(first, F.count("*").alias("rows")).where("rows > 1")
    members = found.distinct().join(groups, "component").select(
        F.col("doc_id").alias(doc_key), F.col("set_id").alias(set_key), (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.set_id") == F.col("set_id"))).alias(stays))
    members = saved(members, "group-members")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(members, F.xxhash64(doc_key)))
    names, schema = docs.columns, docs.schema
    hashed = docs.withColumn(hash_key, F.xxhash64("doc_id"))

    def parts(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = marked(shared.value, batch.column(hash_key).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit == inside)).select(names)

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from parts(batches, False)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(parts(batches, True)):
            ids = [node_of(s) if len(s) else None for s in shingle_sets(texts, shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*names, set_key])

    placed = hashed.mapInArrow(suspects, T.StructType([*schema.fields, T.StructField(set_key, T.LongType())])).alias("d").join(
        members.alias("m"), F.col("d.doc_id").eqNullSafe(F.col(f"m.{doc_key}")) & (F.col(f"d.{set_key}") == F.col(f"m.{set_key}")), "left").select("d.*", stays)
    others = placed.where(F.col(stays).isNull()).select(*names)
    once = placed.where(F.col(stays)).dropDuplicates(["doc_id", set_key]).select(*names)
    return hashed.mapInArrow(outside, schema).unionByName(others).unionByName(once)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), count=True)
