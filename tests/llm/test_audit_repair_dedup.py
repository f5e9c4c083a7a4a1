"""Filter audit, conversation repair and Hamming near-duplicates against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from coord.llm import conversation_repair as repair
from coord.llm import filter_audit as audit
from coord.llm import hamming_dedup as hamming

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


# ---- filter audit


def test_gallop_finds_places():
    r = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 7), (7, 300), (2000, 1500)):
        ids, probes = np.unique(r.integers(0, 4000, n)), np.sort(r.integers(0, 4000, m))
        assert (audit.gallop(ids, probes) == np.searchsorted(ids, probes)).all()
        other = np.unique(probes)
        assert (audit.common(ids, other) == np.isin(ids, other)).all()


def test_removals_are_differences_of_unions():
    r = random.Random(5)
    sets = {f: set(r.sample(range(500), r.randrange(0, 200))) for f in [*audit.FILTERS, audit.GOOD, audit.TOXIC]}
    lists = {k: np.array(sorted(v), np.int64) for k, v in sets.items()}
    seen = 0
    for before, f, removed, good, toxic in audit.removals(lists):
        gone = sets[audit.FILTERS[f]] - set().union(*[sets[x] for k, x in enumerate(audit.FILTERS) if before >> k & 1])
        assert (removed, good, toxic) == (len(gone), len(gone & sets["good"]), len(gone & sets["toxic"]))
        seen += 1
    assert seen == 80


def audited(docs, labels):
    """Brute force: rows of (doc_id, text, source), labels of (doc_id, quality, toxic)."""
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in docs:
        t, w = t or "", words_of(t)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        fails.append((s or "", i, out + "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and i > first[t])))
    rows = {}
    for order in itertools.permutations("ABCDE"):
        for part in {s for s, _, _ in fails}:
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                own = [x for x in fails if x[0] == part and f in x[2]]
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                rows[part, "".join(order), step] = [
                    len(left), len(gone), len(own) - len(gone), sum(x[2] == f for x in own), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone),
                ]
    return [(*k, *v, sum(w[1] for (p, o, n), w in rows.items() if p == k[0] and o[n - 1] == k[1][k[2] - 1])) for k, v in rows.items()]


def test_audit_against_every_order(spark, docs_of, monkeypatch):
    monkeypatch.setattr(audit, "RANGE_BITS", 4)
    r = random.Random(11)
    texts = [None, "", "same text", "x " * 300, " ".join(f"w{k}" for k in range(250)), "ABC def", "a#b " * 210, "\U0001f600 " * 250 + "AB"]
    texts += [" ".join(r.choice(["aa", "Bb", "c%", f"d{k}"]) for k in range(r.randrange(150, 400))) for _ in range(20)]
    rows = [(r.choice([k, k, None, 7]), r.choice(texts), r.choice(["s1", "s1", "s2", None, ""])) for k in range(120)]
    rows += [(1000, "unlike " + " ".join(f"v{k}" for k in range(300)), "clean")]
    labels = [(r.choice([k, None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(120) for _ in range(2)]
    got = audit.audit(docs_of([(i, t, "en", s) for i, t, s in rows]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(audited(rows, [x for x in labels if x[0] is not None]))


def test_audit_of_nothing_and_of_a_long_text(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs_of([]), labels).count() == 0
    got = audit.audit(docs_of([(1, "word " * 400_000, "en", "s")]), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [x.removed for x in got] == [0, 1, 0, 0, 0] and [x.kept for x in got] == [1, 0, 0, 0, 0] and got[1].shapley == 120


# ---- conversation repair


def brute_repair(rows):
    """Cheapest edits by trying all, for (role, text) rows in order with their faults; (cost, audit, repaired)."""
    best = {(0, 0): (0, "", [])}  # (rows done, state)
    out = []
    for done in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for state in (0, 1, 2, 3):
                if (done, state) in best:
                    c, a, lines = best[done, state]
                    role = "assistant" if state == 2 else "user"
                    new, key = (c + 2, a + "I", lines + [role + ":"]), (done, 3 if state == 2 else 2)
                    if key not in best or new[:2] < best[key][:2]:
                        best[key] = new
        if done == len(rows):
            break
        role, text, fault = rows[done]
        for state in (0, 1, 2, 3):
            if (done, state) not in best:
                continue
            c, a, lines = best[done, state]
            ways = [(state, c + 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                late, want = fault == "truncated", "assistant" if state == 2 else "user"
                ways.append((3 if state == 2 else 2, c + 2 + late, "R", [want + ":" + text]))
                if role[:1] == want[0]:
                    ways.append((3 if state == 2 else 2, c + late, "K", [role + ":" + text]))
                if role[:1] == "s" and state == 0:
                    ways.append((1, c + late, "K", [role + ":" + text]))
            for to, cost, edit, more in ways:
                new = (cost, a + edit, lines + more)
                if (done + 1, to) not in best or new[:2] < best[done + 1, to][:2]:
                    best[done + 1, to] = new
    for state in (0, 3):
        if (len(rows), state) in best:
            out.append(best[len(rows), state])
    return min(out, key=lambda x: x[:2])


def brute_report(convs):
    """{conv_id: columns} from (conv_id, turn, role, text) as they are."""
    out = {}
    for conv in {r[0] for r in convs}:
        own = sorted(((t is not None, t or 0, " " if role is None else role, " " if x is None else x) for c, t, role, x in convs if c == conv), key=lambda r: (r[:3], r[3].encode()))
        rows, seen, counts = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for some, t, *_ in own if some]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit_, lines = brute_repair(rows)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit_, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("per_chunk", [1, 3, 128])
def test_repair_against_brute_force(spark, per_chunk):
    r = random.Random(per_chunk)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "Why?", "", " \n", None, "Go on!", "é.", "Fine. \t"]
    convs = [(c, r.choice([t, t, t, None, 3]), r.choice(roles), r.choice(texts)) for c in [*range(60), None] for t in range(r.randrange(1, 9))]
    convs += [(500, t, ("user", "assistant")[t % 2] if t % 7 else "system", f"Line {t}" + "." * (t % 5 > 0)) for t in range(400)]
    df = spark.createDataFrame([(*x, 1) for x in convs], "conv_id long, turn long, role string, text string, conv int")
    got = {x.conv_id: tuple(x)[1:] for x in repair.report(df, rows_per_chunk=per_chunk).collect()}
    assert got == brute_report(convs)


def test_repaired_turns_are_in_order(spark):
    rows = [(2**60 + 1, 0, "system", "Be."), (2**60 + 1, 1, "assistant", "Hi."), (2**60 + 1, 2, "user", "cut")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.turns(repair.repair(df), df).orderBy("conv_id", "place").collect()
    initials = "".join(x.role[0] for x in out)
    assert re.fullmatch("(s?(ua)+)?", initials) and {x.conv_id for x in out} == {2**60 + 1}
    assert repair.report(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(10)] + [(None, None, None, None), (None, 3, None, "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(how, 1)
    assert sorted(map(repr, map(tuple, repair.damaged(df).collect()))) == sorted(map(repr, want))
    report = repair.report(repair.damaged(df), df)
    assert report.count() == 41


def test_grammar_shares_rules(spark):
    seqs = spark.createDataFrame([("s" + "ua" * 64,)] * 5 + [("uaUAx",)], "seq string")
    rules = repair.grammar(seqs)
    assert rules[0][1] in ("ua", "au") and len(rules) < 30
    transfer = repair.Transfer(rules)
    plain = repair.Transfer([])
    for seq in ("s" + "ua" * 64, "uaUAx", "xoSuUaA"):
        assert transfer.sequence(seq) == plain.sequence(seq)


# ---- Hamming near-duplicates


def shingle_set(text):
    w = words_of((text or "").translate(LOW))
    return frozenset(tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(sets)), 2):
        s, t = sets[a][1], sets[b][1]
        if s and t and 100 * len(s & t) >= 85 * len(s | t):
            root[find(a)] = find(b)
    heads = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            heads[find(k)] = min(i, heads.get(find(k), i))
    return [(i, len(s), heads.get(find(k)), i == heads.get(find(k))) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("tile", [256, 8])
def test_components_against_all_pairs(docs_of, rows_of, monkeypatch, tile):
    monkeypatch.setattr(hamming, "TILE", tile)
    r = random.Random(tile)
    def altered(text, n):
        w = text.split()
        for _ in range(n):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        return " ".join(w)
    rows, bases = [], [" ".join(f"w{r.randrange(3000)}" for _ in range(n)) for n in (60, 120, 200)]
    for b in bases:
        for _ in range(25):
            rows.append((len(rows), altered(b, r.choice([0, 1, 2, 3, 4, 8, 20]))))
    chain = bases[0].split()
    for k in range(30):  # each near the next, the ends far apart
        rows.append((len(rows), " ".join(chain[2 * k:] + [f"c{x}" for x in range(2 * k)])))
    rows += [(None, bases[1]), (900, None), (901, ""), (902, " \n "), (903, "a b"), (904, "A  B"), (904, "A  B"), (905, "a b"), (906, "Zz " * 5000), (907, "zz " * 3)]
    assert rows_of(hamming.near_duplicates(docs_of(rows))) == sorted(brute_components(rows), key=repr)


def test_index_finds_all_pairs_within_the_distance():
    r = np.random.default_rng(1)
    for _ in range(300):
        sig = r.integers(0, 2**16, hamming.SIGNATURE).astype(np.uint16)
        other = sig.copy()
        other[r.choice(hamming.SIGNATURE, hamming.DISTANCE, replace=False)] ^= 1
        assert hamming.distances(sig[None], other[None])[0] == hamming.DISTANCE
        a, b = hamming.index_keys(np.stack([sig, other]))
        assert set(a) & set(b) and len(set(a)) == len(a)


def test_hamming_of_nothing_and_of_a_long_text(docs_of):
    assert hamming.near_duplicates(docs_of([])).count() == 0
    long = " ".join(f"w{k}" for k in range(300_000))
    got = {x.doc_id: tuple(x)[1:] for x in hamming.near_duplicates(docs_of([(5, long), (3, long + " end"), (4, None)])).collect()}
    assert got == {5: (299_998, 3, False), 3: (299_999, 3, True), 4: (0, 4, True)}
