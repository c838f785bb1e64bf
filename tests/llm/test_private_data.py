"""Base patterns against plain regular expressions, the field against brute force and held-out sentences."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegraph.llm import private_data as P
from tests.llm.conftest import SF

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: [int(c) for c in m[0] if c.isdigit()]

    def check(ds):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0

    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and check(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a0.@-%+ é", max_size=40), st.text("0159. -+()", max_size=60), st.text("+1 ().-5a", max_size=40)))
def test_base_patterns(text):
    assert P.base_spans(text) == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49 30", "x", "\n", ".", "@", "9" * 20]), max_size=9))
def test_base_patterns_in_rows(parts):
    text = " ".join(parts)
    assert P.base_spans(text) == plain(text)
    assert P.base_spans("".join(parts)) == plain("".join(parts))


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1 ", "1 ", "a@", "@", "(", "0 (", "a1.b2@", "dot ", "1-"])
def test_hostile_texts_are_linear(piece):
    text = piece * (400_000 // len(piece))
    start = time.time()
    P.base_spans(text)
    assert time.time() - start < 3


def test_long_lines_go_in_stretches():
    field = P.fitted()
    text = "4821 " * 30_000 + "call me: jane (at) mail (dot) org " + "77 " * 1000
    start = time.time()
    found = P.added([text], [P.base_spans(text)], field)[0]
    assert [text[a:b] for k, a, b in found if k == 0] == ["jane (at) mail (dot) org"]
    assert time.time() - start < 30


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32))
def test_viterbi_finds_the_best_labels(seed):
    rng = np.random.default_rng(seed)
    words = [[[f"f{rng.integers(6)}" for _ in range(2)] for _ in range(n)] for n in (1, 3, 4)]
    field = P.Field({f"f{i}": i for i in range(6)}, rng.normal(0, 2, (6, P.LABELS)).astype(np.float32), rng.normal(0, 2, (P.LABELS, P.LABELS)).astype(np.float32))

    def value(line, labels):
        out, last = 0.0, 0
        for own, y in zip(line, labels):
            if y and y % 2 == 0 and last not in (y, y - 1):
                return -np.inf
            out, last = out + sum(float(field.weights[field.numbers[f], y]) for f in own), y
        return out + sum(float(field.pairs[a, b]) for a, b in itertools.pairwise(labels))

    for line, got in zip(words, field.decode(words)):
        best = max(value(line, y) for y in itertools.product(range(P.LABELS), repeat=len(line)))
        assert value(line, list(got)) == pytest.approx(best, abs=1e-4)


def test_held_out_sentences():
    rows = P.labelled(1500, 4242)  # another seed: other words, digits and combinations
    base = [P.base_spans(t) for t, _ in rows]
    added = P.added([t for t, _ in rows], base, P.fitted())
    gold = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    beyond = gold - {(i, *s) for i, b in enumerate(base) for s in b}
    got = {(i, *s) for i, a in enumerate(added) for s in a}
    assert len(beyond) > 300 and len(got & gold) >= 0.95 * len(beyond) and len(got & gold) >= 0.97 * len(got)


@pytest.mark.parametrize("text, want", [
    ("Mail jane.doe (at) mail (dot) org now", [("email", "jane.doe (at) mail (dot) org")]),
    ("reach john at example dot com today", [("email", "john at example dot com")]),
    ("call (555) 123-4567 or +1 (017) 555-7713.", [("phone", "(555) 123-4567")]),
    ("blocked 10[.]20[.]30[.]14 again", [("ip", "10[.]20[.]30[.]14")]),
    ("card 4111.1111.1111.1111 was charged", [("card", "4111.1111.1111.1111")]),
    ("a look at the dot on page 12, at 5 pm on 2021-03-04", []),
    ("token = \"ede43f42c939b6405768150e0411590525cf889e\" | 161 | 17", []),
    ("version 2.14.3 of 2020 costs $1,299.00", []),
])
def test_examples(text, want):
    base = P.base_spans(text)
    assert [(P.KINDS[k], text[a:b]) for k, a, b in P.added([text], [base], P.fitted())[0]] == want


def test_addresses_without_digits_or_spelled_dots():
    text = "no line here\n\nWrite to jane (at) mail.org for details."
    assert [text[a:b] for _, a, b in P.added([text], [[]], P.fitted())[0]] == ["jane (at) mail.org"]


def test_all_tokens_of_a_line_are_decoded():
    line = "word " * 400 + "call (555) 123-4567 " + "word " * 400
    assert [t.words for t in P.lines_of(f"x\n{line}\ny")] == [P.TOKEN.findall(line)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "x-", "at", "AT", "@", "(", ")", "[", "]", "dot", "Dot", ".", " ", "  ", "-", "1", "25", "4111111", "111111", "com", "_", "é"]), max_size=14))
def test_lines_left_out_can_hold_nothing(parts):
    line = "".join(parts)
    if not P.able(line):
        assert not any(P.fits(k, line[a:b]) for k in range(4) for a in range(len(line)) for b in range(a + 1, len(line) + 1))


@pytest.mark.parametrize("piece", ["at ", "at-", "@", "@ ", "@a ", "1.", "1 ", "1.1.1x", "1   ", "1" * 50, "at a", "[", " "])
def test_searches_of_lines_are_linear(piece):
    line = piece * (100_000 // len(piece))
    start = time.time()
    P.able(line)
    P.able("@" + line + "x")
    assert time.time() - start < 3


def test_documents(spark, docs, no_docs):
    rows = {r.doc_id: r for r in P.scan_documents(docs).collect()}
    assert P.scan_documents(docs).count() == docs.count() and P.scan_documents(no_docs).count() == 0
    assert (rows[2].n_email, rows[2].spans, rows[2].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    text = "é jane@mail.org, (020) 555-0199\n+1 (017) 555-7713"
    r = P.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.spans == "email:2:15,phone:17:31,phone:32:49" and (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 0, 0, 1, 1)
    assert r.base_sha256 == hashlib.sha256(b"email:2:15,phone:32:49").hexdigest()


def test_whole_table(spark):
    rows = P.op13_private_data(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        shown = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base)]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
