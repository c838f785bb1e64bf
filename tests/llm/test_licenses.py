import re
import textwrap

from sitegraph.llm import licenses as L


def brute(text):
    """Every unit against every template."""
    best = {}
    grams = lambda t: {tuple(w[i:i + 2]) for w in [re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", t.lower()).split()] for i in range(len(w) - 1)}
    known = [(n, grams(t)) for n, t in L.TEMPLATES]
    odd = {w.decode() for w in L.VARIANTS}
    words = lambda g: odd & {w for x in g for w in x}
    numbers = lambda g: {(x, y) for x, y in g if re.fullmatch("[0-9]+", y) and (re.fullmatch("[0-9]+", x) or x in odd | {"version", "v", "by", "attribution"})}
    units = [text] + [u for line in text.split("\n") for u in [line, *re.split(r"(?<=[.!?])\s+(?=[A-Z])", line)]]
    for u in units:
        a = grams(u)
        scored = [(2 * len(a & b) / (len(a) + len(b)), n) for n, b in known if a and numbers(b) <= a and words(a) == words(b)]
        top = max((d for d, _ in scored), default=0)
        if top >= L.THRESHOLD:
            name = next(n for d, n in scored if d == top)
            best[name] = max(top, best.get(name, 0))
    return ",".join(sorted(best)), max(best.values(), default=0.0)


def test_against_all_templates(spark, docs, sf_docs):
    mit = L.TEMPLATES[3][1]
    texts = [(1, mit), (2, "Copyright 2020\n" + mit.replace("free of charge, ", "").replace(". ", ".\n")), (3, "Some words here. Licensed under CC BY-NC 4.0. More words."),
             (4, "licensed under the apache license version 2.0"), (5, "All rights reserved"), (6, "This work is licensed under the GNU Affero General Public License, version 3.")]
    for df in (docs, sf_docs, spark.createDataFrame(texts, "doc_id long, text string")):
        want = sorted(((r["doc_id"] or -1, *brute(r["text"] or "")) for r in df.collect()))
        got = sorted((r["doc_id"] or -1, r["licenses"], r["best_dice"]) for r in L.scan_documents(df).collect())
        assert got == want
    assert [r["best_license"] for r in L.scan_documents(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()] == [
        "MIT", "MIT", "CC-BY-NC-4.0", "Apache-2.0", "proprietary", "AGPL-3.0"]


def test_versions_and_variants_are_told_apart():
    known = L.Templates()
    head = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {head.format("program", "", "2"): "GPL-2.0", head.format("program", "", "3"): "GPL-3.0", head.format("file", "Affero ", "3"): "AGPL-3.0",
             head.format("library", "Lesser ", "2.1"): "LGPL-2.1", head.format("file", "Lesser ", "3"): "LGPL-3.0", head.format("library", "Library ", "2"): "LGPL-2.0",
             "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
             "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
             "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License": "CC-BY-NC-ND-3.0"}
    for text, name in cases.items():
        for whole in (text, f"Some prose stands before.\n{text}\nAnd some stands after."):
            assert [known.names[i] for i in known.scan(whole.encode())] == [name], text
    # a version or variant that no template has is no other licence
    for text in ("Licensed under CC BY 7.0.", head.format("program", "Affero ", "9")):
        assert known.scan(text.encode()) == {}


def test_empty(no_docs):
    assert L.scan_documents(no_docs).count() == 0


def test_wrapped_licences_inside_longer_texts():
    known = L.Templates()
    before = " ".join(f"A long article {i} about thing{i} stands here{i}. It has{i} some sentences{i} of{i} kind{i}." for i in range(40)) + " "
    after = before.replace("A long", "More prose").replace("It has", "They follow")
    for name, text in L.TEMPLATES:
        for width in (40, 70, 80):
            for whole in (before + text + " " + after, before.strip() + "\n\n" + text + "\n\n" + after):
                wrapped = "\n".join(textwrap.fill(part, width) for part in whole.split("\n"))
                assert [known.names[i] for i in known.scan(wrapped.encode())] == [name], (name, width)
    mit = L.TEMPLATES[3][1].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    paragraphs = before + "\n\n" + mit + "\n\n" + after
    assert {known.names[i]: d for i, d in known.scan(paragraphs.encode()).items()} == {"MIT": 1.0}
    assert {known.names[i]: d for i, d in known.scan((before + L.TEMPLATES[6][1] + " " + after).encode()).items()} == {"Apache-2.0": 1.0}


def test_runs_end_on_repeated_lines():
    text = "permission is hereby granted\nunder the terms of the\n" * 20_000
    assert L.Templates().scan(text.encode()) == {}
    assert len(L.Templates().scan(b"All rights\nreserved.\nOther words here.\n" * 20_000)) == 1
