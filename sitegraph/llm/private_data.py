"""Operator 13: personal data by patterns and a linear-chain conditional random field.

The four base patterns (``email``, ``ip``, ``card``, ``phone``) are matched over the whole text. A conditional random
field then labels the tokens of the text (``KINDS`` in begin / inside / outside form) by features of word shape, number groups and neighbours, decoded by Viterbi in numpy batches. It finds what the
patterns leave out: ``jane (at) mail (dot) org``, ``(020) 555-0199``, ``10[.]0[.]0[.]1``, card numbers with other
separators. A decoded span is kept if its digits or parts fit its kind (``fits``) and it overlaps no base span.

The field is trained from a small labelled table (``labelled``): sentences made by rule from templates and fillers,
with the marked parts as labels. The model depends on that table alone and is a few thousand weights.

Defined results: a null or empty text has no findings; texts are read whole. Lines, and stretches of ``BLOCK`` tokens
in a line, are decoded apart (a stretch with ``MARGIN`` tokens on both sides), so a very long line costs time and memory
in proportion. All tokens of a line are decoded; only lines where no span at all could fit its kind (``able``) are not,
as whatever their labels they have no findings.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm.common import slices
from sitegraph.plans.tables import table

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
BLOCK, MARGIN, BATCH = 256, 48, 128
Span = tuple[int, int, int]  # kind, start, end: in the order of the result


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """The base findings, in time linear in the text."""
    out: list[Span] = []
    at = text.find("@")
    last = 0
    while at >= 0:
        if (m := DOMAIN.match(text, at + 1)) and (start := last + len(text[last:at].rstrip(LOCAL))) < at:
            out.append((0, start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        found = m[0].rstrip(" ().-")
        if len(found) >= 4 and 9 <= sum(map(str.isdigit, found)) <= 15:
            out.append((3, m.start(), m.start() + len(found)))
    return out


# --- features -------------------------------------------------------------------

#: Words whose identity, not only their shape, is a feature.
WORDS = frozenset("at dot com org net phone tel telephone call fax mobile cell contact reach dial ring text whatsapp number no nr card visa mastercard amex credit debit pay "
                  "payment charged email mail e write send address ip host server ping gateway order invoice ref reference id version v release isbn page section year "
                  "from to on in of the and or is was www http https point line tracking serial case ticket flight room".split())
DOTS, ATS = (".", "dot"), ("@", "at")
JOINS = frozenset(" ().-/_[]{}")


@dataclass
class Tokens:
    """Tokens of one line: text, start, end."""

    words: list[str]
    starts: list[int]
    ends: list[int]


def shape(word: str) -> str:
    if word[0].isdigit() and word[0].isascii():
        return f"9{min(len(word), 20)}"
    if word[0].isalpha():
        case = "X" if word.isupper() else "x" if word.islower() else "Xx" if word[0].isupper() else "xX"
        return case + ("1" if len(word) == 1 else "2" if len(word) == 2 else "5" if len(word) < 6 else "+")
    return word if word.isascii() else "?"


def _groups(text: str, t: Tokens) -> list[str]:
    """Per token: the digits, parts and check sum of the run of number tokens that it is in (others: nothing)."""
    out, i, n = [""] * len(t.words), 0, len(t.words)
    while i < n:
        if not ("0" <= t.words[i][0] <= "9"):
            i += 1
            continue
        j, last, parts = i + 1, i, 1
        while j < n and t.starts[j] - t.ends[j - 1] <= 2 and j - last <= 4:
            if "0" <= t.words[j][0] <= "9":
                last, parts = j, parts + 1
            elif t.words[j] not in JOINS:
                break
            j += 1
        digits = "".join(w for w in t.words[i:last + 1] if "0" <= w[0] <= "9")
        size = len(digits)
        known = f"g{'<' if size < 7 else '7' if size < 9 else '9' if size < 12 else 'c' if size < 13 else 'k' if size < 20 else '>'}{min(parts, 6)}"
        known += "L" if 13 <= size <= 19 and luhn(digits) else ""
        known += "o" if parts == 4 and all(octet(w) for w in t.words[i:last + 1] if "0" <= w[0] <= "9") else ""
        lead = t.words[i - 1] if i and t.words[i - 1] in "+($#/" else ""
        tight = (i > 0 and t.ends[i - 1] == t.starts[i] and t.words[i - 1][0].isalpha()) or (last + 1 < n and t.ends[last] == t.starts[last + 1] and t.words[last + 1][0].isalpha())
        for k in range(i, last + 1):
            out[k] = f"{known}{lead}{'!' if tight else ''}"
        i = last + 1
    return out


def features(text: str, t: Tokens) -> list[list[str]]:
    """The features of each token of a line."""
    n = len(t.words)
    shapes = [shape(w) for w in t.words]
    names = [low if (low := w.lower()) in WORDS else s for w, s in zip(t.words, shapes)]
    groups = _groups(text, t)
    glued = ["|" if i and t.starts[i] == t.ends[i - 1] else " " for i in range(n)]
    kept, recent = [], []
    for i in range(n):
        recent.append(names[i] if names[i] in WORDS else "")
        kept.append({r for r in recent[max(0, i - 6):i] if len(r) > 2})
    out = []
    for i in range(n):
        before, after = names[i - 1] if i else "<", names[i + 1] if i + 1 < n else ">"
        before2, after2 = names[i - 2] if i > 1 else "<", names[i + 2] if i + 2 < n else ">"
        parts = f"{any(w in DOTS for w in names[i + 1:i + 8]):d}{any(w in ATS for w in names[max(0, i - 8):i]):d}{any(w in ATS for w in names[i + 1:i + 8]):d}"
        near = glued[i] + (glued[i + 1] if i + 1 < n else " ")
        own = [f"w{names[i]}", f"s{shapes[i]}{near}", f"g{groups[i]}", f"gs{groups[i]}{shapes[i]}", f"b{before}", f"a{after}", f"bw{before}{glued[i]}{names[i]}", f"aw{names[i]}{near[1]}{after}",
               f"bb{before2}~{before}~{names[i]}", f"aa{names[i]}~{after}~{after2}", f"B{before2}", f"A{after2}",
               f"ba{before}~{names[i]}~{after}{near}", f"gb{groups[i]}{before}", f"gn{groups[i + 1] if i + 1 < n else ''}", f"gp{groups[i - 1] if i else ''}", f"p{parts}{names[i]}", f"pb{parts}{before}~{names[i]}", f"pa{parts}{names[i]}~{after}"]
        own += [f"k{k}{'9' if groups[i] else ''}" for k in kept[i]]
        own += [f"kg{k}{groups[i]}" for k in kept[i] if groups[i]]
        out.append(own)
    return out


# --- the field ------------------------------------------------------------------

def _allowed() -> np.ndarray:
    """Transitions: an inside label follows a begin or inside label of its kind only."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


ALLOWED = _allowed()


@dataclass
class Field:
    """Weights per feature and label, and per pair of labels."""

    numbers: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def emissions(self, lines: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores ``(line, token, label)``, padded, and the lengths."""
        lengths = np.array([len(x) for x in lines])
        out = np.zeros((len(lines), int(lengths.max(initial=0)), LABELS), np.float32)
        for i, line in enumerate(lines):
            rows, ids = [], []
            for k, own in enumerate(line):
                known = [v for f in own if (v := self.numbers.get(f)) is not None]
                rows += [k] * len(known)
                ids += known
            np.add.at(out[i], rows, self.weights[ids])
        return out, lengths

    def decode(self, lines: list[list[list[str]]]) -> list[np.ndarray]:
        """The best labels of each line: Viterbi over all lines of a batch at once."""
        scores, lengths = self.emissions(lines)
        if not scores.size:
            return [np.zeros(0, int) for _ in lines]
        steps = self.pairs + ALLOWED
        best = scores[:, 0] + np.where(np.arange(LABELS) % 2 == 0, np.where(np.arange(LABELS) > 0, -1e4, 0), 0)
        back = np.zeros(scores.shape, np.int8)
        for t in range(1, scores.shape[1]):
            ways = best[:, :, None] + steps
            back[:, t] = ways.argmax(1)
            new = ways.max(1) + scores[:, t]
            best = np.where((t < lengths)[:, None], new, best)
        label = best.argmax(1)
        out = np.zeros(scores.shape[:2], int)
        for t in range(scores.shape[1] - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = label[inside]
            label = np.where(inside & (t > 0), back[np.arange(len(lines)), t, label], label)
        return [out[i, :n] for i, n in enumerate(lengths)]


def train(lines: list[list[list[str]]], labels: list[list[int]], rounds: int = 70, rate: float = 0.25, decay: float = 0.02) -> Field:
    """Maximum likelihood (forward-backward over all lines at once) with squared penalty, by adaptive steps (Adam)."""
    seen = {f: 0 for line in lines for own in line for f in own}
    numbers = {f: i for i, f in enumerate(sorted(seen))}
    n, lengths = len(lines), np.array([len(x) for x in lines])
    longest = int(lengths.max())
    rows = np.concatenate([np.full(len(own), i * longest + k) for i, line in enumerate(lines) for k, own in enumerate(line)])
    ids = np.array([numbers[f] for line in lines for own in line for f in own])
    gold = np.zeros((n, longest), int)
    for i, y in enumerate(labels):
        gold[i, :len(y)] = y
    real = np.arange(longest) < lengths[:, None]
    one = np.eye(LABELS)[gold] * real[:, :, None]
    gold_pairs = np.einsum("ntx,nty->xy", one[:, :-1], one[:, 1:])
    weights, pairs = np.zeros((len(numbers), LABELS)), np.zeros((LABELS, LABELS))
    first = np.where((np.arange(LABELS) > 0) & (np.arange(LABELS) % 2 == 0), -1e4, 0.0)
    moments = [np.zeros_like(x) for x in (weights, weights, pairs, pairs)]
    by_row, by_id = np.argsort(rows, kind="stable"), np.argsort(ids, kind="stable")
    row_starts, id_starts = (np.concatenate([[0], np.flatnonzero(np.diff(x[o])) + 1]) for x, o in ((rows, by_row), (ids, by_id)))
    row_at, id_at = rows[by_row][row_starts], ids[by_id][id_starts]
    for step in range(1, rounds + 1):
        flat = np.zeros((n * longest, LABELS))
        flat[row_at] = np.add.reduceat(weights[ids[by_row]], row_starts, 0)
        scores = flat.reshape(n, longest, LABELS)
        own, step_to = np.exp(scores - scores.max(2, keepdims=True)), np.exp(pairs + ALLOWED)
        forward, backward, scale = np.zeros_like(own), np.ones_like(own), np.ones((n, longest))
        for t in range(longest):
            new = (forward[:, t - 1] @ step_to if t else np.exp(first)) * own[:, t]
            scale[:, t] = np.where(real[:, t], new.sum(1), 1)
            forward[:, t] = np.where(real[:, t, None], new / scale[:, t, None], forward[:, t - 1])
        expected = np.zeros_like(pairs)
        for t in range(longest - 2, -1, -1):
            ahead = own[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None] * real[:, t + 1, None]
            expected += forward[:, t].T @ ahead * step_to
            backward[:, t] = np.where(real[:, t + 1, None], ahead @ step_to.T, 1)
        chance = forward * backward * real[:, :, None]
        error = (chance - one).reshape(-1, LABELS)
        slope = np.zeros_like(weights)
        slope[id_at] = np.add.reduceat(error[rows[by_id]], id_starts, 0)
        for k, (value, grad) in enumerate(((weights, slope + decay * weights), (pairs, expected - gold_pairs + decay * pairs))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad ** 2 - v)
            value -= rate / (1 + step / 30) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(numbers, weights.astype(np.float32), pairs.astype(np.float32))


# --- the labelled table ---------------------------------------------------------

#: Sentences about personal data (the marked parts are the labels) and about other numbers.
ABOUT = (
    "{email}", "{ip}", "{phone}", "{card}", "Write to {email} for details.", "contact: {email}", "my address is {email}, thanks", "send it to {email} or call {phone}",
    "{w} {w} {email} {w} {w}", "{w} {w} {phone} {w} {w}", "{w} {w}. {card} {w} {w}", "{w} {w} {ip} {w}, {w}", "Please call {phone} before noon.", "Tel.: {phone}", "phone {phone}; fax {phone}",
    "reach me at {phone}", "Mobile: {phone} (evenings)", "card {card} was charged", "Visa {card} exp 04/27", "pay with {card} please", "credit card number: {card}.", "the server {ip} is down",
    "ping {ip} from the gateway", "host {ip} port 8080", "blocked address {ip}, {w} {w}", "{w} | {email} | {w}", "{w} | {phone} | {w}", "{w} | {ip} | {w}", "{w} | {card} | {w}", "<{email}>", "call ({w}) on {phone} or mail {email}",
    "{w}, {w} {w} {email}. {w}", "{w} (at) {w}: {email}, {n2}", "{w}: {phone}, {w}", "{w} {card} {w} {ip} {w}", "{phone} {ip} {w}",
)
OTHER = (
    "{w} {w} dot {w} {w}", "{w} me (at) once: {w} {n}", "{w} (at) {w}, {w} {n2}", "the dot at the end", "a dot com company at {w} street", "look at the dot on page {n}", "meet at {n}:{n2} at the {w}", "order {n6} shipped on {date}", "invoice no. {n9} of {date}",
    "version {n}.{n}.{n} of {w}", "release v{n}.{n}.{n}.{n6}", "version {n3}.{n3}.{n3} of {w}", "{w} {n3}.{n3}.{n3} {w}", "ISBN 978-{n}-{n6}-{n2}-{n}", "see section {n}.{n}.{n} on page {n}", "{price} and {price}", "from {n4} to {n4}", "{n4}-{n4}", "{hex}", "token = \"{hex}\"",
    "secret: {hex} {w}", "AKIA{up}", "{w}{n} {w}{n2} {w}", "| {n} | {n2} | {n4} |", "{n9}", "{n12}", "{n16}", "{w} {n16} {w}", "{w} {w} {n16}. {w}", "{n16} {n16}", "id {n10} {w}", "case {n6}/{n2}", "tracking {up}{n9}",
    "{n} {n} {n} {n} {n}", "{n2}, {n2}, {n4}, {n4}", "{date} {n2}:{n2}:{n2}", "{n}.{n6} {w}", "{n4} {n4} {n4}", "{w} {n2} {w} {n4} {w}", "@{w} {w}", "{w} @ {price}", "{w}@{w}", "cpu {n}.{n} GHz, {n4} MB", "{big}", "http://{w}.{w}/{n6}",
    "{w} {w} {w}, {w}", "x = {n} - {n4} ({n2})", "{n} ({n4}) {w}", "flight {up2} {n4} room {n}", "serial {n4}-{up2}-{n4}", "{n3}-{n2}-{n4}", "({n4}) {w} {w}", "{n4}-{n2}-{n2}T{n2}:{n2}", "{n256}.{n2}.{n2}.{n2}", "#{n6}", "{w} %{n2}%{n2}",
)
#: The domains' last labels.
ENDINGS = ("com", "org", "net", "io", "example", "co.uk", "de")


def _word(r: random.Random) -> str:
    word = "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéä" if r.random() < 0.1 else "aeiou") for _ in range(r.randint(1, 4)))
    return word.capitalize() if r.random() < 0.2 else word


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _email(r: random.Random) -> str:
    plain = lambda: re.sub("[^a-z]", "", _word(r).lower()) or "ana"
    names = [plain() + (_digits(r, 2) if r.random() < 0.3 else "")] + ([plain()] if r.random() < 0.4 else [])
    labels = [plain() + (_digits(r, 1) if r.random() < 0.2 else ""), *r.choice(ENDINGS).split(".")]
    style = r.randrange(8)
    at = (" at ", " (at) ", " [at] ", " AT ", "@", " @ ", "(at)", "[at]")[style]
    dot = (" dot ", " (dot) ", " [dot] ", " DOT ", ".", " . ", "(dot)", "[dot]")[style]
    inner = dot if style != 1 or r.random() < 0.5 else "."
    return inner.join(names) + at + dot.join(labels)


def _ip(r: random.Random) -> str:
    return r.choice((".", ".", "[.]", " . ", "(.)", "[dot]", " dot ")).join(str(r.randrange(r.choice((10, 100, 256, 256)))) for _ in range(4))


def _card(r: random.Random) -> str:
    digits = r.choice("3456") + _digits(r, r.choice((12, 14, 14, 14, 14, 17)))
    digits += next(c for c in "0123456789" if luhn(digits + c))
    by = r.choice(("", " ", "-", ".", "/", "_", "  ", " - "))
    return by.join(digits[i:i + 4] for i in range(0, len(digits), 4)) if by else digits


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"00{a[:2]} {b} {c} {a[:2]}", f"0{a[:2]} {c} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"))


def _fill(name: str, r: random.Random) -> str:
    kinds = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "w": _word}
    if name in kinds:
        return kinds[name](r)
    if name == "date":
        return r.choice((f"20{_digits(r, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{_digits(r, 2)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{_digits(r, 2)}"))
    if name == "price":
        return r.choice(("$", "€", "")) + f"{r.randint(1, 999)},{_digits(r, 3)}.{_digits(r, 2)}"
    if name == "hex":
        return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((24, 32, 40))))
    if name in ("up", "up2"):
        return "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"[:24 if name == "up2" else None]) for _ in range(2 if name == "up2" else 16))
    if name == "big":
        return _digits(r, r.randint(21, 60))
    if name == "n256":
        return str(r.randint(256, 9999))
    if name == "n16":
        while luhn(digits := _digits(r, 16)):
            pass
        return digits
    return _digits(r, int(name[1:] or r.randint(1, 3)))


def labelled(size: int, seed: int) -> list[tuple[str, list[Span]]]:
    """``size`` sentences and the marked spans in them."""
    r, out = random.Random(seed), []
    for _ in range(size):
        text, spans = "", []
        for piece in re.split(r"(\{\w+\})", r.choice(ABOUT if r.random() < 0.55 else OTHER)):
            filled = _fill(piece[1:-1], r) if piece.startswith("{") else piece
            if piece[1:-1] in KINDS:
                spans.append((KINDS.index(piece[1:-1]), len(text), len(text) + len(filled)))
            text += filled
        out.append((text, spans))
    return out


def _marked(text: str, spans: list[Span]) -> tuple[list[list[str]], list[int]]:
    found = list(TOKEN.finditer(text))
    t = Tokens([m[0] for m in found], [m.start() for m in found], [m.end() for m in found])
    labels = [0] * len(found)
    for kind, a, b in spans:
        inside = [i for i in range(len(found)) if a <= t.starts[i] < b]
        for i in inside:
            labels[i] = 2 + 2 * kind
        labels[inside[0]] = 1 + 2 * kind
    return features(text, t), labels


@lru_cache(maxsize=2)
def fitted(size: int = 1200, seed: int = 13) -> Field:
    """The field trained from ``size`` labelled sentences."""
    lines, labels = zip(*(_marked(*row) for row in labelled(size, seed)))
    return train(list(lines), list(labels))


# --- decoding texts -------------------------------------------------------------

AT = re.compile(r"\s*[\[({<]?\s*(?:(?i:\bat\b)|@)\s*[\])}>]?\s*")
DOT = re.compile(r"\s*[\[({<]?\s*(?:(?i:\bdot\b)|\.)\s*[\])}>]?\s*")
#: What every span of a kind holds (see ``fits``): linear searches that miss none.
DIGITS = re.compile("[0-9]+")
FOUR = re.compile(r"(?<![0-9])[0-9]++(?:\s*+[\[({<]?\s*+(?:(?i:\bdot\b)|\.)\s*+[\])}>]?\s*+[0-9]++){3}")
NAMED = re.compile(r"(?:(?i:\bat\b)|@)\s*+[\])}>]?\s*+[A-Za-z0-9-]{1,320}\s*+[\[({<]?\s*+(?:(?i:\bdot\b)|\.)")
WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def fits(kind: int, found: str) -> bool:
    """Whether a decoded span can be of its kind, by its digits or parts."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == 0:
        return len(found) <= 320 and WHOLE_EMAIL.fullmatch(DOT.sub(".", AT.sub("@", found, count=1))) is not None
    if kind == 1:
        parts = DOT.sub(".", found).split(".") if len(found) <= 80 else []
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def able(line: str) -> bool:
    """Whether a line can hold a span that ``fits``: nine digits (a card or phone number), four numbers with dots, or an
    address's at sign, a name and a dot. No other line can, whatever its labels."""
    return sum(map(len, DIGITS.findall(line))) >= 9 or FOUR.search(line) is not None or NAMED.search(line) is not None


def lines_of(text: str) -> Iterator[Tokens]:
    """All tokens of a text, by lines; lines that are not ``able`` are left out."""
    at = 0
    for line in text.split("\n"):
        if able(line):
            t = Tokens([], [], [])
            for m in TOKEN.finditer(text, at, at + len(line)):
                t.words.append(m[0])
                t.starts.append(m.start())
                t.ends.append(m.end())
            yield t
        at += len(line) + 1


def _stretches(t: Tokens) -> Iterator[tuple[Tokens, int, int]]:
    """Parts of a line with margins, and which of their tokens are their own."""
    n = len(t.words)
    for at in range(0, n, BLOCK):
        a, b = max(0, at - MARGIN), min(n, at + BLOCK + MARGIN)
        yield Tokens(t.words[a:b], t.starts[a:b], t.ends[a:b]), at - a, min(at + BLOCK, n) - a


def added(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """The spans that the field finds in each text besides its base spans."""
    jobs = [(k, t, own, to) for k, text in enumerate(texts) for line in lines_of(text) for t, own, to in _stretches(line)]
    order = sorted(range(len(jobs)), key=lambda j: len(jobs[j][1].words))
    decoded: list[np.ndarray] = [np.zeros(0, int)] * len(jobs)
    for at in range(0, len(order), BATCH):
        some = order[at:at + BATCH]
        for j, y in zip(some, field.decode([features(texts[jobs[j][0]], jobs[j][1]) for j in some])):
            decoded[j] = y
    out: list[list[Span]] = [[] for _ in texts]
    kind = start = end = -1

    def close(k: int) -> None:
        nonlocal kind
        if kind >= 0 and fits(kind, texts[k][start:end]):
            out[k].append((kind, start, end))
        kind = -1

    for (k, t, own, to), y in zip(jobs, decoded):
        for i in range(own, to):
            label = int(y[i])
            if label and label % 2 == 0 and kind == label // 2 - 1:
                end = t.ends[i]
                continue
            close(k)
            if label % 2 == 1:
                kind, start, end = label // 2, t.starts[i], t.ends[i]
        if to == len(t.words):  # the line's end
            close(k)
    return [[s for s in found if not any(a < s[2] and s[1] < b for _, a, b in taken)] for found, taken in zip(out, base)]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan_documents(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document with its findings (``SCHEMA``); reads ``doc_id`` and ``text`` alone."""
    model = field or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches):
            texts = [x.decode() for x in raw]
            base = [base_spans(t) for t in texts]
            more = added(texts, base, model)
            rows = [(*(sum(s[0] == k for s in b) for k in range(len(KINDS))), hashlib.sha256(shown(b).encode()).hexdigest(), shown(b + m), len(m)) for b, m in zip(base, more)]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
