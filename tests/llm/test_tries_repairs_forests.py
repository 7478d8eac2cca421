"""Operators 11 to 13 on awkward rows, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from millrace.llm import minhash_forest, prefix_trie, structure_repair
from millrace.llm.common import Scratch

TURNS = "conv_id long, turn long, role string, text string, conv string, node string"


def some_turns(seed, convs=40, nulls=True):
    """Conversations that share turns, with nulls, ties, repeated rows, gaps, faults and one long one."""
    r = random.Random(seed)
    texts = ["", " \t", "Yes.", "No", "Why?", "Ünd so!", "a\nb.", "\x0b"]
    rows = []
    for c in [*range(convs), -3, -5]:
        for t in range(r.randrange(1, 7)):
            turn = None if nulls and r.random() < 0.1 else t + r.randrange(2)
            role = r.choice(["user", "assistant", "system", "tool", "", None if nulls else "user"])
            rows.append((c, turn, role, r.choice([*texts, None if nulls else "x"])))
    rows += rows[:9] + [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t % 5}.") for t in range(30)]
    return [(*row, "x", "y") for row in rows]


def by_order(rows):
    """Each conversation's turns: by turn (null first), role, text."""
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, role, text))
    return {c: [(x[1] if x[0] else None, x[2], x[3]) for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in out.items()}


def crc(text):
    return zlib.crc32(text.encode())


def brute_trie(rows):
    own = by_order([(c, t, role or "", text or "") for c, t, role, text, *_ in rows if c is not None])
    built = {}
    for c, turns in own.items():
        h = crc(str(c)) % 9
        base = int(c - (c - 5 * int(c / 5)))
        built[c] = [x[1:] for x in own.get(base, [])[:h] + turns[h:]]
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def tables(spark, tmp_path):
    def write(rows, schema, name):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, tables, seed):
    rows = [*some_turns(seed), (None, 1, "user", "lost", "x", "y")]
    found = prefix_trie.query(spark, tables(rows, TURNS, "conversations"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_trie(rows)


def test_trie_of_long_chains_and_nested_prefixes(spark):
    """Each conversation is the start of the next one, and two share a long path; chains take few rounds."""
    rows = [(c, t, "user", f"t{t}") for c in range(12) for t in range(c)] + [(50 + c, t, "user", f"u{t}" if t < 300 else f"u{t} {c}") for c in range(2) for t in range(305)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "test")
    digests = prefix_trie.turn_digests(turns, scratch)
    ids = digests.select("conv_id").distinct().unionByName(spark.createDataFrame([(0,)], "conv_id long"))
    got = prefix_trie.prefix_trie(digests, ids, scratch).collect()
    root = next(r for r in got if r.depth == 0)
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves) == (0, 14, 2, 3)
    assert root.saved_tokens == sum((10 - t) * len(f"t{t}") for t in range(11)) + sum(len(f"u{t}") for t in range(300))
    assert len(got) == 1 + 11 + 300 + 10
    assert {(r.depth, r.n_convs) for r in got if r.conv_id < 50 and r.depth} == {(d, 12 - d) for d in range(1, 12)}


def test_trie_of_an_empty_table(spark, tables):
    assert prefix_trie.query(spark, tables([], TURNS, "conversations")).count() == 0


def damage(rows):
    out = []
    for c, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        if way == 1:
            text = ""
        if way == 2:
            text = re.sub("[.!?]", "", text)
        if way == 4:
            role = "user"
        out += [(c, turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def legal(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def cheapest(rows):
    """The best (cost, labels, repaired) by trying edits in order of cost, state by state."""
    seen, start = {}, (0, "", 0, "", ())
    import heapq

    heap = [start]
    while heap:
        cost, labels, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and legal(roles):
            return cost, labels, out
        key = (i, roles[-1:], bool(roles))
        if seen.get(key, (cost, labels)) < (cost, labels):
            continue
        seen[key] = (cost, labels)
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]] if roles else "su"
        for role in ("user", "assistant"):
            if role[0] in fits:
                heapq.heappush(heap, (cost + 3, labels + "I", i, roles + role[0], (*out, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, roles, out))
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if role[:1] and role[0] in fits:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in fits:
                        heapq.heappush(heap, (cost + 3 + more, labels + "R", i + 1, roles + new[0], (*out, f"{new}:{text}")))
    raise AssertionError


def brute_repair(rows):
    hurt = by_order(damage(rows)) if rows else {}
    out = []
    for c in {r[0] for r in rows}:
        turns = hurt.get(c, [])
        seen, marked = set(), []
        for _, role, text in turns:
            body = text.rstrip("\t\n\x0b\x0c\r ")
            marked.append((role, text, "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, labels, repaired = cheapest(marked)
        n = collections.Counter(m[2] for m in marked)
        out.append((c, gaps, n["b"], n["d"], n["t"], illegal, cost, labels, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "block"), [(3, 4096), (4, 4096), (5, 2), (6, 3)])
def test_repairs_by_brute_force(spark, tables, monkeypatch, seed, block):
    """Small blocks spread a conversation over several of them."""
    monkeypatch.setattr(structure_repair, "BLOCK", block)
    rows = [*some_turns(seed, 25), (None, 1, "user", "lost", "x", "y"), (None, 2, "assistant", "lost?", "x", "y")]
    found = structure_repair.query(spark, tables(rows, TURNS, "conversations"))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_repair(rows)


def test_repair_of_empty_tables_and_repaired_rows(spark, tables):
    assert structure_repair.query(spark, tables([], TURNS, "conversations")).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "So?"), (1, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "test")
    rows, signs = structure_repair.symbols(turns, scratch)
    got = structure_repair.repaired(rows, structure_repair.edits_of(signs, scratch)).collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Hi.", "K"), (1, None, "assistant", "", "I"), (1, 2, "user", "So?", "K"), (1, 3, "assistant", "Yes.", "K")]


def test_grammars_and_edits_that_do_not_decide():
    both = structure_repair.Grammar(({"u": 1, "a": 1}, {}), frozenset({1}))
    with pytest.raises(ValueError, match="one of the roles"):
        structure_repair.Composition(both, structure_repair.Edits())
    with pytest.raises(ValueError, match="cost"):
        structure_repair.Composition(structure_repair.CHAT, structure_repair.Edits(insert=0))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(texts):
    found = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        found.append({tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set())
    return found


def brute_components(ids, sets):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [least.get(top(i)) for i in range(len(ids))]


def near_copies(seed, groups=6, copies=25):
    """Texts in groups of copies with more and more edits, besides awkward ones."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    texts = [None, "", " \t", "one", "ONE", "One two", "one  two", "Ünique É", "x " * 5000]
    for g in range(groups):
        base = [word() for _ in range((3, 12, 40, 150, 600, 1500)[g % 6])]
        for k in range(copies):
            now = list(base)
            for _ in range(max(1, len(base) * (k % 9) // 90) if k else 0):
                now[r.randrange(len(now))] = word()
            texts.append(" ".join(now))
    return texts + texts[10:14]


@pytest.mark.parametrize("region", [2048, 8])
def test_near_duplicates_by_brute_force(spark, tables, monkeypatch, region):
    """With small regions the depth grows, and the largest are dealt out as grids."""
    monkeypatch.setattr(minhash_forest, "REGION", region)
    texts = near_copies(1)
    ids = [None if i == 20 else i // 2 if i < 8 else i for i in range(len(texts))]
    rows = [(doc, text, "size", 1) for doc, text in zip(ids, texts)]
    found = minhash_forest.query(spark, tables(rows, "doc_id long, text string, size string, cid int", "documents")).collect()
    sets = word_sets(texts)
    want = [(doc, len(s), c if c is not None else doc, doc == c) for doc, s, c in zip(ids, sets, brute_components(ids, sets))]
    got = [tuple(r) for r in found]
    if region == 2048:
        assert sorted(got, key=repr) == sorted(want, key=repr)
    else:  # deeper regions find a pair with less probability: at least 0.9 of the documents must be placed alike
        alike = collections.Counter(got) & collections.Counter(want)
        assert sum(alike.values()) >= 0.9 * len(want)
        assert sorted(g[:2] for g in got if g[0] is not None) == sorted(w[:2] for w in want if w[0] is not None)


def test_near_duplicates_of_an_empty_table(spark, tables):
    assert minhash_forest.query(spark, tables([], "doc_id long, text string", "documents")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of exactly 0.8: 40 of 50 shingles shared."""
    rows = []
    for p in range(300):
        words = [f"w{p}x{i}" for i in range(46)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, " ".join([*words[:41], *(f"v{p}x{i}" for i in range(5))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_forest.near_duplicates(docs, 2, 4, 5, Scratch(spark, "test"))
    assert found.where("component_id % 2 = 0 AND doc_id % 2 = 1").count() == 300


def test_similarities_that_the_forest_is_not_made_for(spark):
    with pytest.raises(ValueError, match="0.8"):
        minhash_forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2, 1, 2, Scratch(spark, "test"))


def test_signatures_are_of_sets():
    a, b = (minhash_forest.shingles(t, 2, minhash_forest.WordHashes()) for t in ("a b c a b", "c a b c"))
    assert (minhash_forest.signature(a) == minhash_forest.signature(b)).all()
