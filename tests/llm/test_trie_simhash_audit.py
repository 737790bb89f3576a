"""The prefix trie, fuzzy SimHash and filter audit against brute force and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from shutterlake.llm import entry, filter_audit, golay_simhash, oracles, prefix_trie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_filter_audit"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = con.execute(oracles.SQL[name])
    names = [x[0] for x in out.description]
    frame = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame, names) == sorted(out.fetchall(), key=str)


# ---- prefix trie

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_hand(sequences):
    """Rows of TRIE for {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, []
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [sums[q] for q in children.get(p, [])]
        sums[p] = (own + sum(b[0] for b in below), sum(b[1] for b in below) if below else 1)
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children.get(p, [])), sums[p][1], sums[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    """Turns of each conversation; ties by digest of the turn."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}


def rebuilt_by_hand(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = abs(c) % 100 * (1 if c >= 0 else -1)
        out[c] = own.get(c - lead, [])[:h] + turns[h:]
    return out


def conversations():
    rng = random.Random(3)
    rows = []
    long = [(("user", "bot")[i % 2], f"turn {i} é") for i in range(150)]
    talks = {100: long, 101: long[:64], 102: long[:8], 103: long[:9] + [("user", "else")] + long[10:100], 104: long[:80] + [("bot", "x")] * 60, 105: long, 106: long, 201: [("user", "a")], 305: [("user", "b")] * 3, -120: long[:20], -7: [("user", "hi")] * 9}
    for c in range(400, 520):
        talks[c] = [(rng.choice(["user", None]), rng.choice(["yes", "no", "", None, "maybe so"])) for _ in range(rng.randint(1, 12))]
    for c, turns in talks.items():
        rows += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    return [*rows, (450, 1, "user", "tie"), (450, 1, "user", "tie"), (450, None, "bot", "first"), (None, 1, "user", "nobody"), (451, 2, None, None)]


def test_trie_of_awkward_conversations(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "'own' AS id", "'own' AS node", "1 AS n", "2 AS d").repartition(5)
    assert rows_of(prefix_trie.trie_digest(frame), TRIE) == trie_by_hand(rebuilt_by_hand(ordered(rows)))
    assert rows_of(prefix_trie.prefix_trie(prefix_trie.as_they_are(prefix_trie.turns_of(frame))), TRIE) == trie_by_hand(ordered(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie_digest(none).collect() == []
    alone = [(c, 1, "user", "x") for c in (301, 302, 303, 304, 305)]  # their leader is absent
    got = rows_of(prefix_trie.trie_digest(spark.createDataFrame(alone, CONVERSATIONS)), TRIE)
    assert got == trie_by_hand(rebuilt_by_hand(ordered(alone)))


def test_lists_of_ids_are_split_and_joined(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_CHARS", 50)
    ids = random.Random(1).sample(range(-10_000, 10_000), 500)
    frame = spark.createDataFrame([(1, 2, i) for i in ids[:400]] + [(1, 3, i) for i in ids[400:]], "a long, b long, conv_id long").repartition(6)
    got = {r.node.b: r.ends_sha256 for r in prefix_trie._listed(frame).collect()}
    assert got == {b: hashlib.sha256(",".join(map(str, sorted(part))).encode()).hexdigest() for b, part in ((2, ids[:400]), (3, ids[400:]))}


# ---- SimHash


def simhash_by_hand(text):
    ws = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids, prints):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            root[top(i)] = top(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(i)
    least = {g: min((ids[i] for i in own if ids[i] is not None), default=None) for g, own in groups.items()}
    return [least[top(i)] for i in range(len(ids))]


def test_golay_code_is_perfect():
    golay = golay_simhash.Golay()
    assert sorted(golay.errors.tolist()) == sorted(sum(1 << b for b in c) for n in range(4) for c in itertools.combinations(range(23), n))
    words = np.random.default_rng(0).integers(0, 1 << 23, 300)
    near = golay.codewords(words, 23)
    for word, own in zip(words.tolist(), near.tolist()):
        assert len(set(own)) in (1, 6)
        for i, j in itertools.combinations(range(23), 2):
            assert set(own) & set(golay.codewords(np.array([word ^ 1 << i ^ 1 << j]), 23)[0].tolist()) if (i + j) % 7 == 0 else True


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 2016, dtype=np.uint64)
    pairs = np.array(list(itertools.combinations(range(64), 2)))
    other = base ^ np.uint64(1) << pairs[:, 0].astype(np.uint64) ^ np.uint64(1) << pairs[:, 1].astype(np.uint64)
    golay = golay_simhash.Golay()
    sets = []
    for prints in (base, other):
        keys, at = golay_simhash.fuzzy_keys(prints, golay)
        sets.append([set(keys[at == i].tolist()) for i in range(len(prints))])
    assert all(a & b for a, b in zip(*sets))


def texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(8)]
    out = [None, "", " \t", "one", "ONE", "one two", "one  two", "a b c", "a b c d", "é ß 你 好", "x" * 3000 + " y z " + base[0]]
    for t in base:
        out.append(t)
        for _ in range(14):
            ws = t.split(" ")
            ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            out.append(" ".join(ws))
    return out + [base[1].upper(), base[1].replace(" ", "\n\n"), base[2] * 60]


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(golay_simhash, "PART", 500)
    rows = [(i * 3 % 171, t) for i, t in enumerate(texts())] + [(None, texts()[12]), (None, "alone here now"), (5, "one"), (5, "one")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'own' AS key", "'own' AS root", "1 AS n", "'own' AS simhash").repartition(4)
    prints = [simhash_by_hand(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], components_by_hand([i for i, _ in rows], prints)), key=str)
    assert len({w[2] for w in want}) < len(rows) - 20
    assert rows_of(golay_simhash.simhash_components(frame), ["doc_id", "fingerprint", "component_id"]) == want
    # The same with every key full.
    monkeypatch.setattr(golay_simhash, "FEW", 1)
    assert rows_of(golay_simhash.simhash_components(frame), ["doc_id", "fingerprint", "component_id"]) == want
    assert golay_simhash.simhash_components(frame.limit(0)).collect() == []


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(2)
    prints = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = golay_simhash._links(spark.createDataFrame([(p,) for p in signed], "simhash long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    assert len(links) < 65 * len(prints)
    root = {p: p for p in signed}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in links:
        root[top(r.a)] = top(r.b)
    want = dict(zip(signed, components_by_hand(signed, [p & (1 << 64) - 1 for p in signed])))
    groups = {}
    for p in signed:
        groups.setdefault(top(p), set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


# ---- filter audit

AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_by_hand(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a null id has no labels
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, t, source in rows:
        t = t or ""
        ws = WORD.findall(t)
        bad = "".join(f for f, x in zip("ABCDE", [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows)]) if x)
        parts.setdefault(source or "", []).append((i, bad))
    out = []
    for part, docs in parts.items():
        runs = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = sum(f in d[1] for d in docs)
                runs.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(d[1] == f for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        shapley = {f: sum(r[4] for r in runs if r[1][r[2] - 1] == f) for f in "ABCDE"}
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in runs]
    return sorted(out, key=str)


def test_orders_differ_by_one_swap():
    for n in range(6):
        order = list(range(n))
        met = {tuple(order)}
        for level in filter_audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            met.add(tuple(order))
        assert met == set(itertools.permutations(range(n)))
        assert len(list(filter_audit.adjacent_swaps(n))) == len(met) - 1


def test_swapped_diagram_is_the_one_built_in_that_order():
    rng = random.Random(6)
    for _ in range(30):
        weights = {m: (rng.randint(1, 3), 0, rng.randint(0, 1)) for m in rng.sample(range(32), rng.randint(0, 20))}
        diagram = filter_audit.Diagram(weights)
        for _ in range(40):
            diagram.swap(rng.randrange(4))
            size, reached = 0, {diagram.root}
            for _ in range(5):
                reached = {c for n in reached for c in diagram.nodes[n][:2]} - {0}
            assert {diagram.nodes[n][2] for n in reached} == set(weights.values())
            for f, left, gone in diagram.steps():
                size |= 1 << f
                total = [w[0] for m, w in weights.items() if not m & size]
                assert left[0] == sum(total)


def test_audit(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(4))
    rows = []
    for i in range(160):
        n = rng.choice([0, 10, 49, 50, 80, 300])
        t = " ".join(rng.choice(["la", word(), "UPPER" if i % 3 == 0 else word(), "# |" if i % 5 == 0 else word()]) for _ in range(n))
        rows.append((i, t, rng.choice(["s1", "s1", "s2", None, ""])))
    rows += [(200 + i, rows[i % 7][1], "s1") for i in range(40)] + [(None, rows[0][1], "s2"), (None, None, None), (7, rows[7][1], "s1"), (7, rows[7][1], "s2"), (-1, rows[5][1], "s3"), (300, "Ab " * 60, "s4")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 220, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "'own' AS mask", "'own' AS part", "1 AS quality", "1 AS n").repartition(4)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert rows_of(filter_audit.filter_audit(docs, table), AUDIT) == audit_by_hand(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), table).collect() == []
