"""Filter audit, fill-in-the-middle and license scan against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from loomtext.llm import audit, fim, license

SPACES = " \t\n\x0b\x0c\r"
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, "word " * 300, "a"), (5, "word " * 300, "b"), (5, "word " * 300, "b"), (5, "other " * 210, "b"), (None, "word " * 300, "a"), (None, None, None),
    (6, " ".join(f"w{i}" for i in range(250)), "a"), (7, " ".join(f"w{i}" for i in range(250)) + " #", "a"), (8, "ÄÖ ABC DEF ü", "b"), (9, "x<P>y z", "b"), (10, "a < b <P b c\u0085d 😀 e", "c"),
    (11, "\ttail  space \n", "c"), (12, "y" * 200_000 + " " + "z " * 30_000, "c"), (0, "word " * 300, "d"), (-3, "Released under the MIT License. under the mit license", "d"),
]


def table(spark, rows=ODD):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, "x", 1, "y") for i, t, s in rows], "doc_id long, text string, source string, part string, mask int, _w string")


def plain_words(text: str, spaces: str = SPACES) -> list[str]:
    return [w for w in re.split(f"[{spaces}]+", text) if w]


def plain_audit(rows, labels) -> dict:
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    texts = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, s in texts:
        w = plain_words(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = i is not None and any(j is not None and j < i and t == u for j, u, _ in texts)
        fails.append((i, s, {k for k, v in f.items() if v}))
    out = {}
    for part in {s for _, s, _ in fails}:
        own = [(i, f) for i, s, f in fails if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [i for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                shapley[name] += len(gone)
                redundant = sum(1 for _, f in own if name in f and f & set(order[: step - 1]))
                rows.append((part, "".join(order), step, name, (len(left), len(gone), redundant, sum(1 for _, f in own if f == {name}), len([i for i in gone if i in good]), len([i for i in gone if i in toxic]))))
        out |= {(p, o, k): (*counts, shapley[name]) for p, o, k, name, counts in rows}
    return out


def got_audit(df) -> dict:
    rows = df.collect()
    out = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit(spark):
    labels = [(1, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, None), (6, None, 1), (7, 1, 0), (None, 1, 1), (99, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got_audit(audit.audit(table(spark), marks)) == plain_audit(ODD, labels)
    assert audit.audit(table(spark).filter("false"), marks).collect() == []
    no_labels = audit.audit(table(spark), marks.filter("false"))
    assert got_audit(no_labels) == plain_audit(ODD, [])


def test_audit_hot_text(spark):
    """A text that most rows share, over several parts and partitions, with small chains in between."""
    r = random.Random(5)
    rows = [(i, "same text " * 120 if r.random() < 0.6 else f"text {r.randrange(40)} " * r.randrange(1, 130), f"s{r.randrange(3)}") for i in range(400)]
    r.shuffle(rows)
    labels = [(i, r.randrange(2), r.randrange(2)) for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    assert got_audit(audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == plain_audit(rows, labels)


def test_audit_chains_of_colliding_texts(monkeypatch):
    """Different texts of one fingerprint stay apart; a chain that is handed on early gives the same rows."""
    rows = [(5, "p", 1, 7, "a"), (3, "q", 2, 7, "b"), (4, "p", 1, 7, "a"), (9, "p", 2, 7, "b"), (4, "q", 1, 7, "a"), (3, "q", 2, 7, "b"), (None, "p", 1, 7, "a"), (8, "p", 1, 2, "a")]
    expected = sorted([(5, "p", 1 | audit.COPY, 1), (4, "p", 1, 1), (4, "q", 1, 1), (3, "q", 2, 2), (9, "p", 2 | audit.COPY, 1), (8, "p", 1, 1), (-1, "p", 1, 1)])
    for size in (audit.CHAIN_BYTES, 300):
        monkeypatch.setattr(audit, "CHAIN_BYTES", size)
        sent = sorted(audit._routed(iter(rows)), key=lambda x: x[0])
        merged: dict = {}
        for i, p, m, n in audit._judged(iter(sent)):
            key = (-1 if i is None else i, p, m)
            merged[key] = merged.get(key, 0) + n
        assert sorted((*k, n) for k, n in merged.items()) == expected
        # copies known within the task travel without their text
        if size > 300:
            assert sum(k[1] == 0 for k, _ in sent) == 3


def plain_fim(doc_id, text) -> tuple:
    text = text or ""
    units = re.findall(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+", text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fim(spark):
    r = random.Random(3)
    rows = ODD + [(i, "".join(r.choice(["a", "<", "P", "S>", "<S", "M", " ", "\n", "é", "😀 "]) for _ in range(r.randrange(60))), None) for i in range(20, 400)]
    got = [tuple(x) for x in fim.digests(fim.arrange(table(spark, rows))).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[5])
    assert sorted(got, key=key) == sorted((plain_fim(i, t) for i, t, _ in rows), key=key)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert fim.digests(fim.arrange(table(spark).filter("false"))).collect() == []


def test_fim_shares_and_texts(spark):
    """The shares are parameters; the operator's own output is the text."""
    df = table(spark, [(i, f"one two three {i}", "s") for i in range(200)])
    assert {x["form"] for x in fim.arrange(df, plain_from=0).collect()} == {"plain"}
    rows = fim.restore(fim.arrange(df, seed=7, plain_from=100, spm_below=0)).collect()
    assert {x["form"] for x in rows} == {"psm"} and all(x["restored"] == x["text"] for x in rows)
    assert all(re.fullmatch(r"<P>(.*)<S>(.*)<M>(.*)", x["output"], re.S) for x in rows)


def plain_licenses(text, known, least=license.LEAST_SHARE) -> tuple:
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if x]
    found = []
    for t in known:
        for at in range(len(w)):
            if all(" ".join(w[at + k : at + k + len(p.split())]) == p for k, p in t.keys):
                share = sum(at + k < len(w) and w[at + k] == x for k, x in enumerate(t.words)) / len(t.words)
                if share >= least:
                    found.append((t.label, at, share, t.base))
    base = [x for x in found if x[3]]
    label = lambda rows: ",".join(sorted({x[0] for x in rows}))
    places = [x[1] for x in base]
    return len(w), len(base), min(places, default=None), max(places, default=None), label(base), label(found), round(max((x[2] for x in found), default=0.0), 6)


def test_licenses(spark):
    r = random.Random(11)
    notices = [n for _, n, _ in license.NOTICES] + ["Under the MIT-License", "Apache License, Version 2.0", "CC BY-NC", "cc by nc cc by nc", "gnu general public license version 3", "under the mitİ license", "under the Kmit license"]
    rows = [(i, t, s) for i, t, s in ODD]
    for i in range(100, 500):
        words = r.choice(notices).split()
        if r.random() < 0.5:
            words[r.randrange(len(words))] = r.choice(["the", "license", "x"])
        lead = [r.choice(["under", "the", "license", "version", "gnu", "Prosa", "é"]) for _ in range(r.randrange(12))]
        rows.append((i, r.choice(["/* ", "", "# "]) + " ".join(lead + words * r.randrange(1, 3)), "s"))
    rows += [(600, " ".join(n for n in notices), "s"), (601, "license " * 5000 + "under the mit license", "s")]
    known = license.templates()
    got = [(x[0], *x[1:-1], round(x[-1], 6)) for x in license.licenses(table(spark, rows)).collect()]
    expected = [(i, *plain_licenses(t, known)) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert {x for row in got for x in row[6].split(",")} >= {n for n, _, _ in license.NOTICES} | set(license.BASE.values())
    assert any(0 < x[-1] < 1 for x in got)
    assert license.licenses(table(spark).filter("false")).collect() == []


def test_license_index(spark):
    """The rarest words of key phrases are indexed; what is found does not depend on the frequencies."""
    known = license.templates({"b a": "base"}, [("n", "x y a b z", ("a b", "z"))])
    df = spark.createDataFrame([(1, "a a b"), (2, "x Y a b z"), (3, "A.b"), (4, None), (5, "b a b a")], "doc_id long, text string")
    counts = license.frequencies(df, known)
    assert counts == {"a": 4, "b": 4, "z": 1}
    assert license.index(known, counts, 2) == [[(1, "a"), (0, "b")], [(4, "z"), (2, "a")]]
    one = sorted(map(tuple, license.scan(df, known, license.index(known, counts, 1)).collect()))
    assert one == sorted(map(tuple, license.scan(df, known, license.index(known, {}, 3)).collect()))
    assert one[4][2:7] == (2, 0, 2, "base", "base") and one[1][6] == "n"
    with pytest.raises(ValueError):
        license.templates({}, [("n", "x y", ("z",))])
