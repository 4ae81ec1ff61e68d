"""Manifest, shards and source divergence beside plain versions, with nulls, repeats, ties and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanwright.llm import divergence, merkle, shards

UP = str.maketrans(merkle.UPPER, merkle.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID int, node string, row int, key string, shard int"
EXTRA = (1, "x", 1, "x", 1)
ODD = [
    *[(1, "Ab ab été", "en", "s", 9, *EXTRA)] * 5,
    (None, None, None, None, None, *EXTRA), (None, "X", None, "s", 1, *EXTRA), (3, "", "de", None, 0, *EXTRA), (4, "", "de", None, 0, *EXTRA),
    (6, "ÄBC\n x " + "verylongword" * 9 + " " + "verylongword" * 9 + "x", None, None, 7, *EXTRA), (7, "Word " * 40_000, "en", "t", 9, *EXTRA),
    *[(10 + i, f"T{i} ab verylongwordone verylongwordtwo verylongwordon verylongwo", "zz", f"s{i % 7}", 1, *EXTRA) for i in range(100)],
]
CASES = {"all": ODD, "empty": [], "one": ODD[:1], "repeated": ODD[:5], "null": ODD[5:6]}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    encoded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        hit = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        h = [sha("".join(map(encoded, (doc_id, source, lang, n_chars, t)))) for t in (text, text.translate(UP) if hit else text)]
        langs[lang].append((doc_id is not None, doc_id or 0, *h))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def climb(levels, pos, h, siblings):
        for level in levels[:-1]:
            run, slot = level[pos // 8 * 8 : pos // 8 * 8 + 8], pos % 8
            siblings += run[:slot] + run[slot + 1 :]
            h, pos = sha("".join([*run[:slot], h, *run[slot + 1 :]])), pos // 8
        return h

    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: tree([x[2] for x in sorted(langs[n])]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for i, n in enumerate(names):
        for p, (has, doc_id, a, b) in enumerate(sorted(langs[n])):
            siblings = []
            folded = climb(top, i, climb(trees[n], p, b, siblings), siblings)
            out.append((doc_id if has else None, a, trees[n][-1][0], top[-1][0], sha("".join(siblings)), folded, folded == top[-1][0]))
    return out


def plain_divergence(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        words = term.findall((text or "").translate(UP))
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= 3]

        def share(c, kept=kept):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:200]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES)
def test_edge_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, merkle.audited(df).collect()), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert sorted(map(tuple, divergence.audited(df).collect())) == sorted(plain_divergence(rows))
    check_shards(rows, shards.assigned(df).collect(), 40)


def check_shards(rows, found, n):
    text = [r[1] or "" for r in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((r[0], len(t.encode()) + 16, zlib.crc32(t.encode())) for r, t in zip(rows, text, strict=True))
    of = defaultdict(list)
    for r in found:
        of[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(slots) == list(range(len(slots))) for slots in of.values())
    counts = [len(of[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)


def test_high_trees_and_blocks(spark, monkeypatch):
    """Blocks of two levels, so that runs above blocks are repeated; many trees below the top one."""
    monkeypatch.setattr(merkle, "BLOCK", 1)
    monkeypatch.setattr(merkle, "IN_BLOCK", 8)
    rows = [(i, f"Text {i}", f"l{i % 20}" if i % 3 else "hot", "s", i, *EXTRA) for i in range(1500)]
    got = merkle.audited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))
    # Tampering is found where it changes a text, and nowhere else
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0) for r in got)


def test_groups_stay_together_and_giants_fill_whole_shards(spark):
    """Groups that fit a shard are whole; one of a third of all rows is in few more shards than it needs."""
    texts = ["giant"] * 400 + [f"group {i // 5}" for i in range(300)] + [f"alone {i}" for i in range(500)]
    rows = [(i, t, "en", "s", 1, *EXTRA) for i, t in enumerate(texts)]
    found = shards.assigned(spark.createDataFrame(rows, SCHEMA), 12).collect()
    check_shards(rows, found, 12)
    at = defaultdict(set)
    for r in found:
        at[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in at.items() if t.startswith("group"))
    assert len(at["giant"]) <= 6


def test_all_linked(spark):
    """Without free rows shards exchange rows within their slack, and the law holds in the end."""
    texts = [f"group {i // 4}" for i in range(800)]
    rows = [(i, t, "en", "s", 1, *EXTRA) for i, t in enumerate(texts)]
    found = shards.assigned(spark.createDataFrame(rows, SCHEMA), 8).collect()
    check_shards(rows, found, 8)
    at = defaultdict(set)
    for r in found:
        at[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) == 1 for s in at.values()) >= 0.8 * len(at)


words = st.text(alphabet="abzé а.Z", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("st"), words), max_size=12))
def test_pointer_sort(rows):
    """Runs of sorted pointers are the words with their counts, whatever their lengths."""
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
    got = divergence.slice_counts(*columns)
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(UP))
        n.update((lang, w, source) for w in found)
        docs.update((lang, w, source) for w in set(found))
    assert (got.to_pylist() if got else []) == [dict(zip(("lang", "term", "source", "n", "docs"), (*k, n[k], docs[k]), strict=True)) for k in sorted(n, key=lambda k: (k[1].encode(), *order(rows, k)))]


def order(rows, key):
    """Languages and sources in the order they are met in."""
    langs, sources = (list(dict.fromkeys(r[i] for r in rows)) for i in range(2))
    return langs.index(key[0]), sources.index(key[2])


def test_shares_are_exact():
    count, total = np.array([0, 1, 4_000_000_000_000, 8_999_999_999_999_998]), 8_999_999_999_999_999
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]
