import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import zlib
from urllib.parse import quote

from sitegraph.llm import secrets as S

SECRET = "token = abcdef123456"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    """Base findings by the plain patterns, failing matches dropped afterwards."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_findings(spark, docs, sf_docs):
    for df in (docs, sf_docs):
        texts = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
        want = sorted(((i or -1, *(sum(k == j for _, k, _ in plain(t)) for j in range(3)), hashlib.sha256(S.shown(plain(t)).encode()).hexdigest()) for i, t in texts))
        got = sorted((r["doc_id"] or -1, r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in S.scan_documents(df).collect())
        assert got == want


def test_failing_match_takes_its_text():
    assert S.scan("secret: token: abcdefgh") == [] == plain("secret: token: abcdefgh")
    assert S.scan("ſecret: abcdefgh, toKen=abcdefgh") == []
    assert S.scan("PassWord='x+/_.=-9'") == plain("PassWord='x+/_.=-9'") != []


def test_layers_are_unwrapped_and_mapped():
    inner = base64.b64encode(SECRET.encode()).decode()
    for text in (inner, quote(SECRET, safe=""), quote(inner, safe=""), "".join(f"\\u{ord(c):04x}" for c in SECRET),
                 base64.b64encode(gzip.compress(SECRET.encode())).decode(), base64.b64encode(zlib.compress(inner.encode())).decode(),
                 base64.b64encode(quote(inner).encode()).decode(), "".join(f"&#{ord(c)};" for c in SECRET)):
        base, found, layers, _ = S.findings(f"héad ({text}) tail")
        decoded = [x for x in found if x not in base]
        assert any(k == 0 for _, k, _ in decoded) and layers > 1, text
        for a, _, b in decoded:
            assert 6 <= a < b <= 6 + len(text)


def test_base64_span_is_narrow():
    padding = "x" * 30
    text = base64.b64encode((padding + " " + SECRET + " " + padding).encode()).decode()
    (a, _, b), = S.findings(text)[1]
    assert b - a < len(text) * 0.6
    assert SECRET.encode() in base64.b64decode(text[a // 4 * 4:-(-b // 4) * 4])


def test_cycles_and_bombs_end():
    text = SECRET
    for _ in range(12):
        text = base64.b64encode(text.encode()).decode()
    assert any(k == 0 for _, k, _ in S.findings(text)[1])
    bomb = base64.b64encode(gzip.compress(b"0" * 10_000_000)).decode()
    assert S.findings(bomb, max_layer=1 << 20)[3] == 1
    assert S.findings(quote("%25" * 2000))[2] < 10


def every_layer(text):
    """Findings of all escape layers, one after another to the fixpoint (texts alone)."""
    seen, work, out = set(), [text], set()
    while work:
        t = work.pop()
        if t in seen:
            continue
        seen.add(t)
        out |= {(k, t[a:b]) for a, k, b in S.scan(t)}
        work += [re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), t),
                 re.sub(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});", lambda m: chr(int(m[3]) if m[3] else int(m[1] or m[2], 16)), t)]
    return out


def test_nested_escapes():
    def percent(t):
        return "".join(f"%{ord(c):02x}" for c in t)

    def unicode(t):
        return "".join(f"\\u{ord(c):04x}" for c in t)

    wraps = (percent, unicode, lambda t: quote(t, safe=""), lambda t: t.replace("%", "%25").replace("\\", "\\x5c"), lambda t: "".join(f"&#{ord(c)};" for c in t))
    rng = random.Random(4)
    for depth in range(1, 9):
        for _ in range(6):
            text = SECRET
            for _ in range(depth):
                wrap = rng.choice(wraps)
                text = wrap(text) if len(text) < 20_000 else quote(text)
            whole = f"héad ({text}) tail"
            found = S.findings(whole)[1]
            assert any(k == "assign" for k, _ in ((S.KINDS[k], t) for k, t in every_layer(whole)))
            assert any(k == 0 and 6 <= a < b <= 6 + len(text) for a, k, b in found), whole[:80]


def test_cascade_is_the_fixpoint():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["%", "25", "2", "5", "\\x", "\\u00", "41", "&#", "37;", "x25;", "a", " "]) for _ in range(rng.randrange(1, 40)))
        layer = S._cascaded(S.Layer(text))
        if layer is None:
            assert not S.PERCENT.search(text) and not S.ESCAPE.search(text)
            continue
        assert not S.PERCENT.search(layer.text) and not S.ESCAPE.search(layer.text)
        assert len(layer.text) == len(layer.start) == len(layer.end) and layer.start[0] == 0 and layer.end[-1] == len(text)
        assert (layer.start[1:] == layer.end[:-1]).all()  # the spans tile the text


def test_long_nested_escapes_end():
    start = time.monotonic()
    text = "%" + "25" * 250_000 + "74oken=abcdef123456"
    base, found, layers, _ = S.findings(text)
    assert (0, 0, len(text)) in found and layers < 20
    assert any(k == 0 for _, k, _ in S.findings("\\x5c" + "x5c" * 100_000 + "x74oken=abcdef123456")[1])
    assert time.monotonic() - start < 30


def test_wrapped_base64():
    filler = "".join(f"line {i * 7919} of some filler text\n" for i in range(40))
    for data in ((filler + SECRET + "\n" + filler).encode(), *(pack((filler + SECRET).encode()) for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress))):
        flat = base64.b64encode(data).decode()
        for width in (64, 76):
            for end in ("\n", "\r\n", "\n    "):
                lines = end.join(flat[i:i + width] for i in range(0, len(flat), width))
                for text in (f"key: |{end}{lines}{end}Thanks", f"-----BEGIN X-----{end}{lines}{end}-----END X-----", f'data = "{lines}"; more'):
                    base, found, _, _ = S.findings(text)
                    assert not [x for x in base if x[1] == 0] and any(k == 0 for _, k, _ in found), (width, end, text[:20])
                    assert "[REDACTED]" in S.redact(text)
    token = "token = abcdef123456"
    for pad in range(30, 70):  # the secret lies across a line end
        flat = base64.b64encode(("x" * pad + " " + token + " " + "y" * 40).encode()).decode()
        text = flat[:64] + "\n" + flat[64:128] + ("\n" + flat[128:] if flat[128:] else "")
        (a, _, b), = S.findings(text)[1]
        assert token in base64.b64decode("".join((text[:a] + text[a:b]).split()) + "====").decode("latin-1") and b - a < 40


def test_all_members_and_all_of_a_large_layer():
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        text = base64.b64encode(pack(b"first member") + pack(SECRET.encode())).decode()
        assert [k for _, k, _ in S.findings(text)[1]] == [0]
        for at in (100, 99_990, 1_500_000):
            large = base64.b64encode(pack(b"a b\n" * (at // 4) + b" " + SECRET.encode() + b" " + b"c d\n" * 400_000)).decode()
            _, found, _, limited = S.findings(large, max_layer=100_000)
            assert [k for _, k, _ in found] == [0] and limited == 1


def test_redaction(docs):
    rows = {r["doc_id"]: r for r in S.redact_documents(docs).collect() if r["doc_id"] is not None}
    assert rows[1]["text"].startswith("[REDACTED] and [REDACTED]\nalpha") and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] is None and rows[2]["n_chars"] is None and rows[3]["text"] == "" and rows[5]["n_chars"] == 5
    assert S.redact_documents(docs).schema == docs.schema


def test_empty(no_docs):
    assert S.scan_documents(no_docs).count() == 0 == S.redact_documents(no_docs).count()
