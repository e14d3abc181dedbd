"""Conversation repair, embedding near-duplicates and the prefix trie against brute force, with the awkward cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from motionframe.llm import catalog, conversation_repair, embedding_dedup, prefix_trie

rng = random.Random(11)
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def conversations():
    rows = []
    for c in range(60):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(0, 4)
        for k, role in enumerate(roles):
            role = role if rng.random() < 0.85 else rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Is it so?", "cut off", "", " \t", None, "Ende", "a\nb.", "é…", f"line {k}. "])
            rows.append((c, rng.choice([k, k, k, k + 3, None]), role, text, "s", 1))
    rows += [(71, k, ["user", "assistant"][k % 2], f"turn {k % 3}.", None, None) for k in range(120)]  # a long one
    rows += [(72, 0, "user", "word " * 40_000 + ".", None, None), (72, 1, "assistant", "ok.", None, None)]
    rows += [(73, 5, "user", "Same.", None, None)] * 3 + [(None, 0, "user", "Nobody's.", None, None), (None, None, "assistant", "Nor this.", None, None), (-3, 0, "user", "Below zero.", None, None), (-3, 2**60 + 1, "assistant", "Far.", None, None)]
    for c in range(100, 130):  # copies
        rows += [(c, 0, "user", "Hello.", None, None), (c, 1, "assistant", "Hi!", None, None), (c, 2, "user", f"{c % 3}", None, None)]
    return rows


ROWS = conversations()
SCHEMA = "conv_id long, turn long, role string, text string, signature string, base int"


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


# ---- repair ----------------------------------------------------------------------------------------------


def crc(s):
    return zlib.crc32(s.encode())


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]
        code = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1], x[2])[:16])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The least (cost, audit, repaired rows) over all edits, state by state, with whole strings."""

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit, made) in list(best.items()):
                to = NEXT[state]
                new = (cost + 5, audit + "I", made + [{"u": "user:", "a": "assistant:"}[to]])
                best[to] = min(best.get(to, new), new)
        return best

    best = inserts({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        fresh = {}

        def offer(state, found):
            fresh[state] = min(fresh.get(state, found), found)

        for state, (cost, audit, made) in best.items():
            offer(state, (cost + 2, audit + "D", made))
            if fault in ("b", "d"):
                continue
            extra = 5 if fault == "t" else 0
            to = NEXT[state]
            offer(to, (cost + 1 + extra, audit + "R", made + [{"u": "user:", "a": "assistant:"}[to] + text]))
            i = role[:1]
            if (i == "s" and state == "") or (i == "u" and state in ("", "s", "a")) or (i == "a" and state == "u"):
                offer(i, (cost + extra, audit + "K", made + [role + ":" + text]))
        best = inserts(fresh)
    return min(best[s] for s in ("", "a") if s in best)


def test_repair(spark, convs, monkeypatch):
    monkeypatch.setattr(conversation_repair, "table", lambda s, d, name: convs)
    got = {r.conv_id: r for r in catalog.QUERIES["op11_conversation_repair"](spark, "").collect()}
    want = damage(ROWS)
    assert set(got) == set(want) and None in got
    for conv, rows in want.items():
        r, f = got[conv], faults(rows)
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, made = brute_repair(rows)
        assert (r.blank, r.duplicate, r.truncated) == tuple(f.count(x) for x in "bdt"), conv
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()), conv
    assert conversation_repair.repaired(convs.where("false")).count() == 0


def test_edits_of_short_signatures():
    """All signatures of up to five rows by trying every edit, and layers shared in sorted order."""
    marks = "suaTx".replace("T", "U")
    signatures = sorted("".join(s) for n in range(5) for s in itertools.product(marks, repeat=n))

    def tried(s):
        found = []

        def go(i, state, cost, audit, inserts):
            if i == len(s) and state in ("", "a"):
                found.append((cost, audit))
            if inserts < 2:
                go(i, NEXT[state], cost + 5, audit + "I", inserts + 1)
            if i < len(s):
                go(i + 1, state, cost + 2, audit + "D", 0)
                if s[i] != "x":
                    extra, r = 5 * s[i].isupper(), s[i].lower()
                    go(i + 1, NEXT[state], cost + 1 + extra, audit + "R", 0)
                    if (r, state) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                        go(i + 1, r, cost + extra, audit + "K", 0)

        go(0, "", 0, "", 0)
        return min(found)

    some = [s for k, s in enumerate(signatures) if len(s) < 4 or k % 7 == 0]
    assert {s: (c, a) for s, c, a in conversation_repair.walked(iter(some))} == {s: tried(s) for s in some}
    long = "us" * 20_000
    assert len(next(conversation_repair.walked(iter([long])))[2]) >= len(long)


# ---- embeddings ------------------------------------------------------------------------------------------


def vectors():
    g = np.random.default_rng(5)
    rows, i = [], 0
    for label in (0, 1, 2, None):
        for _ in range(12):
            centre = g.normal(size=16)
            for _ in range(g.integers(1, 7)):
                rows.append((i, (centre + g.normal(size=16) * g.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist(), label))
                i += 1
    base = rows[0][1]
    far = np.nextafter(np.float32(1), np.float32(2)).item()
    rows += [(500, base, 0), (501, base, 0), (501, base, 0), (502, [2 * x for x in base], 0), (503, base, 1), (504, [x * far for x in base], 0), (None, base, 0)]
    rows += [(510, None, 0), (511, [], 0), (512, [0.0] * 16, 0), (513, [float("nan")] + base[1:], 0), (514, [None] + base[1:], 0), (515, [float("inf")] + base[1:], 0), (516, base[:8], 0), (517, base[:8], 0), (2**60 + 1, [1e-30 * x for x in base], 0)]
    return rows


def test_embedding_dedup(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies int, width string").repartition(3)
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = defaultdict(set)
    for p, q in itertools.combinations(range(len(rows)), 2):
        (i, a, x), (j, b, y) = rows[p], rows[q]
        if None in (i, j, x, y) or x != y or not ok(a) or not ok(b) or len(a) != len(b):
            continue
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
            links[p].add(q)
            links[q].add(p)
    want = defaultdict(list)
    for p, (i, _, _) in enumerate(rows):
        seen, todo = {p}, [p]
        while todo:
            for q in links[todo.pop()] - seen:
                seen.add(q)
                todo.append(q)
        least = None if i is None else min(rows[q][0] for q in seen)
        want[i].append((len(links[p]), least, i is None or least == i))
    assert sum(map(len, links.values())) > 60
    for block in (2048, 5):
        out = defaultdict(list)
        for r in embedding_dedup.near_duplicates(df, block=block).collect():
            out[r.vec_id].append((r.n_links, r.component_id, r.kept))
        assert {k: sorted(v, key=repr) for k, v in out.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    monkeypatch.setattr(embedding_dedup, "table", lambda s, d, name: df)
    assert catalog.QUERIES["op12_embedding_dedup"](spark, "").count() == len(rows)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_bounds_hold():
    g = np.random.default_rng(2)
    for width in (1, 3, 64, 1500):
        x = np.array([embedding_dedup.unit(g.normal(size=width) * g.choice([1e-3, 1, 100], width)) for _ in range(40)])
        q = embedding_dedup.quantised(x)
        about, off = embedding_dedup.bounds(q, q)
        assert (np.abs(about - x @ x.T) <= off).all() and off.max() < 0.05


# ---- trie ------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[-1] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in turns:
        h = crc(str(c)) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_prefix_trie(spark, convs, monkeypatch):
    monkeypatch.setattr(prefix_trie, "table", lambda s, d, name: convs)
    monkeypatch.setattr(prefix_trie, "END_RANGE", 8)  # ids of one end then come from several ranges
    got = sorted(map(tuple, catalog.QUERIES["op13_prefix_trie"](spark, "").collect()), key=repr)
    assert got == brute_trie(ROWS)
    assert prefix_trie.trie(convs.where("false")).count() == 0
    # A conversation whose turns are all replaced by those of an absent base has none: it ends at the root.
    lone = next(c for c in range(1, 1000) if c % 5 and crc(str(c)) % 9 > 1)
    one = spark.createDataFrame([(lone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in prefix_trie.trie(one).collect()] == brute_trie([(lone, 0, "user", "x")])


# ---- models against plain versions -------------------------------------------------------------------------


def test_compiled_trees_equal_the_fitted_model(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from motionframe.llm import url_filter

    kept, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df: kept.append((fit(self, df), df)) or kept[0][0])
    r = random.Random(3)
    rows = []
    for k in range(400):
        bad = k % 3 == 0
        host = "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) + ("-win-" + str(r.randint(100, 9999)) if bad else "") + r.choice([".com", ".org", ".net"])
        rows.append((f"https://{host}/{'/'.join('x' * r.randint(1, 9) for _ in range(r.randint(0, 4)))}?{'&'.join(f'a{i}=1' for i in range(r.randint(0, 5)))}", bad != (r.random() < 0.2)))
    model = url_filter.fit(spark.createDataFrame(rows, "url string, blocked boolean"))
    fitted, frame = kept[0]
    assert len(model.trees) == len(fitted.trees) > 1
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    both = fitted.transform(frame).select(vector_to_array("probability")[1].alias("p"), model.chance({c: F.col(c) for c in (*url_filter.LEXICAL, "suffix_rate")}).alias("q")).collect()
    assert len(both) == len({u for u, _ in rows}) and max(abs(b.p - b.q) for b in both) < 1e-12 and len({round(b.q, 9) for b in both}) > 5


def test_quality_scores_by_plain_loops(spark):
    """Features by regular expressions, weights that no step can improve, scores by the formula."""
    from motionframe.llm import quality_classifier as qc

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))
    texts = [" ".join(word() for _ in range(r.randint(3, 80))) + ("!!! $$ 99 | |\n" + "x x x x y " * 4 if k % 2 else ".\n" + word()) for k in range(80)] + ["", "   ", "Été ÀB"]

    def measured(t):
        raw = t.encode()
        words, n = raw.split(), max(len(raw.split()), 1)
        count = lambda p: len(re.findall(p, raw)) / n
        lines = [x for x in raw.split(b"\n") if x.strip()]
        fours = {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        return [
            np.log1p(len(words)) / 8, min(max(len(raw), 1) / n / 10, 3), min(count(rb"[#*$%&<>@^~=+_{}\[\]\\]"), 3), min(count(rb"\|"), 1), min(count(rb"!"), 2), min(count(rb"[A-Z]") / 2, 3), min(count(rb"[0-9]"), 2), min(count(rb"[.,;:?'\"()-]"), 2),
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(words)) / n, (len(fours) + 1) / max(len(words) - 2, 1), len(set(lines)) / max(len(lines), 1), min(len(zlib.compress(raw, 1)) / max(len(raw), 1), 1.5), float(len(words) < 20),
        ]

    x = np.array([measured(t) for t in texts])
    assert np.allclose(x, [qc.features(t) for t in texts])
    good = np.arange(len(texts)) % 2 == 0
    m = qc.fit_pairs(x, good, pairs=10**6)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -8, 8)
    g = np.random.default_rng(5)
    n = min(10**6, int(good.sum() * (~good).sum()))
    d = z[g.choice(np.flatnonzero(good), n)] - z[g.choice(np.flatnonzero(~good), n)]
    loss = lambda w: np.logaddexp(0, -d @ w).mean() + 5e-4 * w @ w
    w = np.array(m.weights)
    assert all(loss(w) <= loss(w + s * e) + 1e-12 for e in np.eye(len(w)) for s in (-1e-3, 1e-3))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.s for r in df.select("i", qc.score(df.text, m).alias("s")).collect()}
    cut = np.quantile(z @ w, (~good).sum() / len(good), method="midpoint")
    want = 1 / (1 + np.exp(-(z @ w - cut + np.log(0.3 / 0.7))))
    assert np.allclose([got[i] for i in range(len(texts))], want)
