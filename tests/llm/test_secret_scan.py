"""Secrets under layers of encodings, their places in the text, bombs and cycles."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from weftline.llm import secret_scan as s

SECRET = 'password = "hunter2hunter2"'


def scanned(text):
    work = s.Worklist(text)
    work.run(text, s.matches(text))
    return work


def spans(text):
    return [(s.KINDS[k], a, b) for a, k, b in sorted(scanned(text).found)]


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


def percent(x):
    return "".join(f"%{b:02X}" for b in x.encode())


def slashed(x):
    return "".join(f"\\u{ord(c):04x}" for c in x)


def test_fixed_patterns_as_by_a_plain_reading():
    rng = random.Random(2)
    parts = ["password", "PassWD", "secret", "token", "apikey", "API_key", "ſecret", "=", ":", " = ", "\"", "'", "abcdef", "abcde", "AKIA", "AKIA" + "Z9" * 8, "deadbeef" * 3, "0123456789abcdef01234567", "-", "\n", " ", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert s.matches(text) == sorted(plain(text)), text


def plain(text):
    """The patterns, character by character."""
    found, low = [], "".join(c.lower() if c.isascii() else c for c in text)
    i = 0
    while i < len(text):
        key = next((k for k in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(k, i)), None)
        j = i + len(key) if key else i
        if key:
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "=") and j < len(text):
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"') and j < len(text)
                e = j
                while e < len(text) and (text[e].isascii() and text[e].isalnum() or text[e] in "+/_.=-"):
                    e += 1
                if e > j:
                    found += [(i, 0, e)] if e - j >= 6 else []
                    i = e
                    continue
        i += 1
    for kind, begin, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), (2, "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            e = i
            while e < len(text) and text[e] in chars:
                e += 1
            at = text.find(begin, i, e)
            if e > i and at >= 0 and e > at + len(begin):
                found += [(at, kind, e)] if e - at >= least else []
            i = max(e, i + 1)
    return found


def test_each_layer_alone_and_its_place():
    assert spans("say " + percent(SECRET) + " here") == [("assign", 4, 4 + 3 * 26)]  # the closing quote is not part of it
    assert spans("é " + slashed(SECRET)) == [("assign", 2, 2 + 6 * 26)]
    for escape in ("&#97;", "&#x61;", "\\x61", "\\u{61}", "\\U00000061", "%61"):
        text = f"x p{escape}ssword=abcdef y"
        assert spans(text) == [("assign", 2, len(text) - 2)], escape
    for packed in (b64(SECRET), b64(SECRET).replace("+", "-").replace("/", "_").rstrip("="), b64(SECRET.encode("utf-16-le")), b64(gzip.compress(SECRET.encode())), b64(zlib.compress(SECRET.encode())), b64(bz2.compress(SECRET.encode())), b64(lzma.compress(SECRET.encode())), b64(zstandard.compress(SECRET.encode()))):
        assert spans(f"« {packed} »") == [("assign", 2, 2 + len(packed))], packed
    for times in range(5, 12):
        code = b64(SECRET * times)
        wrapped = "\n".join(code[i : i + 76] for i in range(0, len(code), 76))
        assert ("assign", 1, 1 + len(wrapped)) in spans(f"<{wrapped}>")
        assert ("assign", 1, 1 + len(wrapped)) in spans(f"<{wrapped}\nword>")
    other = b64(SECRET) + "\nAnotherLongWordThatIsNone/AtAll"
    assert spans(other) == [("assign", 0, len(b64(SECRET)))]
    assert spans(f"key-{b64(SECRET)}") == [("assign", 4, 4 + len(b64(SECRET)))]
    raw = "".join(map(chr, gzip.compress(SECRET.encode())))
    assert ("assign", 2, 2 + len(raw)) in spans(f"» {raw}")


def test_base_spans_stay_when_a_layer_changes_them():
    assert spans("token=abcdef%41%42 x") == [("assign", 0, 12), ("assign", 0, 18)]
    assert spans("token=abc%41 x") == []
    assert spans("token=abc%41%41%41 x") == [("assign", 0, 18)]


def test_nested_layers_in_any_order():
    rng = random.Random(4)
    wraps = {
        "url": percent,
        "unicode": slashed,
        "base64": b64,
        "gzip": lambda x: b64(gzip.compress(x.encode())),
        "twice": lambda x: b64(zlib.compress(gzip.compress(x.encode()))),
    }
    for _ in range(60):
        text, used = SECRET, []
        while len(used) < 5 and len(text) < 20_000:
            used.append(rng.choice(list(wraps)))
            text = wraps[used[-1]](text)
        found = spans(f"before {text} after")
        inner = [x for x in found if x[0] == "assign"]
        assert inner and all(7 <= a < b <= 7 + len(text) for _, a, b in inner), used


def test_escapes_of_escapes_to_the_end():
    text = SECRET
    for _ in range(12):
        text = text.replace("%", "%25") if "%" in text else percent(text)
    work = scanned(text)
    assert ("assign" in {s.KINDS[k] for _, k, _ in work.found}) and not work.unopened
    assert scanned("%25" * 3 + "41").opened >= 1
    assert not scanned("\\ud800 \\u{110000} &#0; &#55296;").unopened


def test_bombs_are_counted_and_cycles_end(monkeypatch):
    bomb = b64(gzip.compress(b"a" * 60_000_000))
    work = scanned(f"{bomb} password=abcdefg")
    assert work.unopened == 1 and (len(bomb) + 1, 0, len(bomb) + 17) in work.found
    deep = scanned("%" + "25" * 40_000)
    assert deep.unopened == 1
    monkeypatch.setattr(s, "inflated", lambda raw, most: raw if raw.startswith(b"\x1f\x8b\x08") else None)
    assert scanned(b64(b"\x1f\x8b\x08" + b"q" * 30)).unopened == 0


def test_frames_with_nulls_ties_and_other_columns(spark):
    deep = b64(gzip.compress(percent(SECRET).encode()))
    rows = [(1, f"x {deep}", "a"), (1, f"x {deep}", "a"), (2, None, None), (3, "", "b"), (None, SECRET, "c"), (4, "long " * 200_000 + SECRET, "d"), (5, "nothing", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, s._digest(s.secrets(docs)).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    one = hashlib.sha256(b"assign:0:26").hexdigest()
    late = hashlib.sha256(b"assign:1000000:1000026").hexdigest()
    nested = f"assign:2:{2 + len(deep)}"
    want = [(1, 0, 0, 0, none, nested, 2, 0)] * 2 + [(2, 0, 0, 0, none, "", 0, 0), (3, 0, 0, 0, none, "", 0, 0), (None, 1, 0, 0, one, "assign:0:26", 0, 0), (4, 1, 0, 0, late, "assign:1000000:1000026", 0, 0), (5, 0, 0, 0, none, "", 0, 0)]
    assert got == sorted(want, key=str)
    assert s.secrets(docs.where(F.lit(False))).count() == 0
