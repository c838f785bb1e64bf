"""Operator 10: benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items build one suffix automaton over words. A document's words stream through it; at each
word the automaton gives the longest match that ends there. Where it reaches a window's length, the window's words
are hit. Documents over the coverage limit are contaminated; ``remove_spans`` cuts long or dense hits out instead.

A window is ``window`` consecutive words of an item; an item with fewer words (but some) is one window. The items
are broadcast in blocks of at most ``BLOCK_WORDS`` words (a proven bound); a larger benchmark takes several
automata, one after another, over the same rows, and their hits are united.

Defined results: a null or empty text has no words and is never contaminated; items without words match nothing;
items that repeat an id count once; a null item_id is no item; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import slices
from sitegraph.plans.tables import table

WINDOW, COVERAGE, BLOCK_WORDS = 13, 20, 200_000
#: Bytes of words: digits, letters (A-Z as a-z) and all bytes of characters beyond ASCII; the rest separates.
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """A generalised suffix automaton over the words of all items of a block."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[set[str]] = [set()]  # items whose windows end in the state
        texts = [(item, words(text)) for item, text in items]
        for _, ws in texts:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for item, ws in texts:
            state = 0
            for i, w in enumerate(ws):  # every window of the item, by the state of the last `window` words
                state = self.next[state][w] if i < window else self._step(state, w)
                if i + 1 >= window:
                    self.ids[state].add(item)
            if 0 < len(ws) < window:
                self.short[state].append((len(ws), item))
        self.shorter: list[list[tuple[int, str]] | None] = [None] * len(self.next)
        self.homes: dict[int, int] = {}  # states above a window's, to the window's

    def _extend(self, last: int, w: bytes) -> int:
        if (known := self.next[last].get(w)) is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, w, known)
        new = self._state(self.length[last] + 1)
        at = last
        while at != -1 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            known = self.next[at][w]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._clone(at, w, known)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ids.append(set())
        return len(self.next) - 1

    def _clone(self, at: int, w: bytes, known: int) -> int:
        new = self._state(self.length[at] + 1)
        self.next[new] = dict(self.next[known])
        self.link[new] = self.link[known]
        self.link[known] = new
        while at != -1 and self.next[at].get(w) == known:
            self.next[at][w] = new
            at = self.link[at]
        return new

    def _step(self, state: int, w: bytes) -> int:
        """From a window's state to the next window's: add a word and keep the last ``window`` words."""
        state = self.next[state][w]
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words. Each way up the suffix links is walked once, so repeated words cost
        no more than others."""
        way, at = [], state
        while at not in self.homes and self.length[self.link[at]] >= self.window:
            way.append(at)
            at = self.link[at]
        at = self.homes.get(at, at)
        self.homes.update(dict.fromkeys(way, at))
        return at

    def _short_at(self, state: int) -> list[tuple[int, str]]:
        """Short items that end in the state or in a suffix of it."""
        if (out := self.shorter[state]) is None:
            out, at = [], state
            while at > 0:
                out += self.short[at]
                at = self.link[at]
            self.shorter[state] = out
        return out

    def hits(self, ws: list[bytes], mark: bytearray | None, items: set[str]) -> bytearray | None:
        """Mark the words inside occurrences of windows (``mark`` is made at the first) and collect their items."""
        steps, link, lengths, window = self.next, self.link, self.length, self.window
        any_short = any(self.short)
        state = matched = 0
        for i, w in enumerate(ws):
            to = steps[state].get(w)
            if to is None:
                while state and (to := steps[state].get(w)) is None:
                    state = link[state]
                    matched = lengths[state]
                to = steps[state].get(w)
                if to is None:
                    matched = 0
                    continue
            state = to
            matched += 1
            if matched >= window:
                mark = mark or bytearray(len(ws))
                mark[i + 1 - window:i + 1] = b"\1" * window
                items |= self.ids[self._window_state(state)]
            if any_short:
                for n, item in self._short_at(state):
                    if n <= matched:
                        mark = mark or bytearray(len(ws))
                        mark[i + 1 - n:i + 1] = b"\1" * n
                        items.add(item)
        return mark


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size; one block at a time is on the driver (a longer item is a block)."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct().orderBy("item", "text")
    block, n = [], 0
    for row in items.toLocalIterator():
        block.append((row["item"], row["text"].encode()))
        n += len(block[-1][1].split())
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


AUTOMATA: dict[str, Automaton] = {}  # of this Python worker, by block


def _automata(blocks) -> list[Automaton]:
    for old in set(AUTOMATA) - {b[0] for b in blocks}:
        del AUTOMATA[old]
    for key, shared, window in blocks:
        if key not in AUTOMATA:
            AUTOMATA[key] = Automaton(shared.value, window)
    return [AUTOMATA[key] for key, _, _ in blocks]


def _blocks(benchmark: DataFrame, window: int) -> list:
    sc = benchmark.sparkSession.sparkContext
    return [(uuid.uuid4().hex, sc.broadcast(items), window) for items in item_blocks(benchmark)]


def document_hits(text: bytes, automata: list[Automaton]) -> tuple[int, bytearray | None, set[str]]:
    ws, mark, items = words(text), None, set()
    for a in automata:
        mark = a.hits(ws, mark, items)
    return len(ws), mark, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE) -> DataFrame:
    """One row per document; contaminated if ``coverage`` times its hit words reach its words."""
    blocks = _blocks(benchmark, window)

    def run(batches):
        automata = _automata(blocks)
        for batch, texts in slices(batches):
            rows = []
            for text in texts:
                n, mark, items = document_hits(text, automata)
                hit = mark.count(1) if mark else 0
                rows.append((n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and coverage * hit >= n))
            types = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]],
                                             names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, span: int | None = None) -> DataFrame:
    """``docs`` (same columns) without contaminated documents. With ``span``, documents under the coverage limit
    also lose hit stretches of at least so many words, and the white space and marks inside them."""
    blocks, names = _blocks(benchmark, window), docs.columns

    def run(batches):
        automata = _automata(blocks)
        for batch, texts in slices(batches):
            keep, new = [], []
            for text in texts:
                n, mark, _ = document_hits(text, automata)
                hit = mark.count(1) if mark else 0
                keep.append(not (hit and coverage * hit >= n))
                new.append(remove_spans(text, mark, span) if span and mark else text)
            columns = batch.columns
            if span:
                k = names.index("text")
                columns[k] = pa.array([t.decode() if v else None for t, v in zip(new, batch.column(k).is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(text: bytes, mark: bytearray, span: int) -> bytes:
    """The text without the stretches of at least ``span`` marked words."""
    flat, places, at = text.translate(NORMAL), [], 0
    for w in flat.split(b" "):
        if w:
            places.append((at, at + len(w)))
        at += len(w) + 1
    out, done, i = [], 0, 0
    while i < len(mark):
        j = i
        while j < len(mark) and mark[j]:
            j += 1
        if j - i >= span:
            out.append(text[done:places[i][0]])
            done = places[j - 1][1]
        i = max(j, i + 1)
    return b"".join([*out, text[done:]])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all(coalesce({lower}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS p FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[p + 1:p + n], ' ') AS k FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words("text")} AS w FROM documents),
dn AS (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS p FROM d JOIN (SELECT DISTINCT n FROM windows) s ON len(w) >= n),
hits AS (SELECT r, p, n, item FROM (SELECT r, p, n, array_to_string(w[p + 1:p + n], ' ') AS k FROM dn) x JOIN windows USING (n, k)),
marked AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AND {COVERAGE} * coalesce(m.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN marked m ON m.r = d.r LEFT JOIN items i ON i.r = d.r
"""
