"""Conversation repair, alignment of tokenizers, sharding."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from headway.llm import alignment, queries, repair, sharding
from tests.llm.test_edges import CLASHES, LONG

# ---- conversation repair

TURNS = "conv_id long, turn long, role string, text string"


def plain_audit(letters):
    """The least (cost, audit) by the grammar's states, from the last turn back."""
    best = {"z": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for x in reversed(letters):
        initial, fault = "suax"[repair.LETTERS.index(x) // 4], repair.LETTERS.index(x) % 4
        new = {}
        for state, then in best.items():
            new[state] = [(then[0] + 4, "D" + then[1])]
            if fault in (repair.FINE, repair.CUT_OFF):
                stays = 3 * (fault == repair.CUT_OFF)
                wanted = "a" if state == "u" else "u"
                options = [("K", initial, stays)] if initial == wanted or (initial, state) == ("s", "z") else []
                options += [("R", wanted, stays + 3)] if initial != wanted else []
                new[state] += [(best[to][0] + cost, edit + best[to][1]) for edit, to, cost in options]
        low = {s: min(o) for s, o in new.items()}
        put = lambda to, low=low: (low[to][0] + 3, "I" + low[to][1])
        u, a = min(low["u"], put("a")), min(low["a"], put("u"))
        then = (u[0] + 3, "I" + u[1])
        best = {"z": min(low["z"], then), "s": min(low["s"], then), "u": u, "a": a}
    return best["z"][1], best["z"][0]


def test_audits_are_the_least_of_the_cheapest():
    r = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40]:
        for _ in range(60):
            letters = "".join(r.choices(repair.LETTERS, [3, 1, 1, 2, 9, 1, 2, 3, 9, 1, 1, 2, 1, 1, 1, 1], k=n))
            assert repair.audit_of(letters) == plain_audit(letters), letters


def test_a_long_conversation_keeps_few_rows():
    letters = "".join(random.Random(6).choices("EFGHIJKLA", [20, 1, 1, 2, 20, 1, 1, 2, 1], k=2500))
    assert repair.audit_of(letters) == plain_audit(letters)
    rows = [("suax"[k // 4], k % 4) for k in map(repair.LETTERS.index, letters)]
    assert len(repair.Tables(rows).kept) <= 2500 // 50 + 2


def damaged(rows):
    """By hand: (conv_id, turn, role, text) after damage, and all conv_ids."""
    out = []
    for conv, turn, role, text in rows:
        cell = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{cell(conv)}:{cell(turn)}".encode()) % 20
        role, text = cell(role), cell(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def by_hand(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, letters, faults = set(), "", []
        for _, _, role, text in own:
            end = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = 1 if not end else 2 if (role, text) in seen else 0 if end in ".!?" else 3
            seen.add((role, text))
            faults.append(fault)
            letters += repair.LETTERS[4 * max(0, "suax".find(role[:1] if role[:1] in "sua" and role else "x")) + fault]
        turns = {r[1] for r in own} - {None}
        audit, cost = plain_audit(letters)
        left, at, lines = sum(x != "D" for x in audit), 0, []
        for x in audit:
            wanted = "assistant" if left % 2 else "user"
            if x == "I":
                lines.append(f"{wanted}:")
            else:
                if x != "D":
                    lines.append(f"{own[at][2] if x == 'K' else wanted}:{own[at][3]}")
                at += 1
            left -= x != "D"
        initials = [r[2][:1] for r in own]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


ODD = [
    (None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (1, None, "assistant", "x!"), (1, None, "assistant", "x!"), (1, 9, "", "no role."),
    (1, 3, "tool", " "), (1, 3, "system", "\t\n"), (2, 5, "user", LONG), (2, 6, "assistant", LONG + "end?"), (2, 7, "üser", "é"), *((3, t, "user", "same.") for t in range(40)),
    *((4, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(60)), *((1 << 62, t, "system", "s.") for t in (7, 7, -3)),
    *((k, 0, "user", "one.") for k in range(100, 160)),
]


def test_repair_by_hand(spark):
    rows = spark.createDataFrame(ODD, TURNS).select("*", *(F.lit("clash").alias(c) for c in [*CLASHES, "dropped", "found", "letter", "nth", "digest"]))
    turns = repair.damage(rows)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(turns).collect()}
    assert found == by_hand(ODD)
    assert any(audit == "" for *_, audit, _ in found.values())  # conversations that lost all rows
    lines = collections.defaultdict(list)
    for r in repair.repaired_turns(turns).orderBy("position").collect():
        assert len(lines[r["conv_id"]]) == r["position"]
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, (*_, audit, sha) in found.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == sha
        assert len(lines[conv]) == len(audit.replace("D", ""))


def test_repair_of_nothing(spark):
    turns = repair.damage(spark.createDataFrame([], TURNS))
    assert repair.repair(turns).collect() == []
    assert repair.repaired_turns(turns).collect() == []


# ---- alignment

PATHS = [queries.tokenizer_path(x) for x in queries.ALIGNED]
TEXTS = [
    "The cat sat, and they're 12 34 it's   ok\n\n  no.", "The cat sat.", "The cat sat.", "", None, " ", "  a  b ", "▁x y", "日本語 text 😀 word", "<|endoftext|> a <s> b", "a\0b c\r\n\td",
    "x" * 3000, "word " * 300, "ﬁne é é", "a b", " lead", "trail ", "　wide", "日本語" * 60, "\x1c a \x85 b", "gap here and there",
]


def plain_alignment(texts):
    a_model, b_model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    entry, letters = {v: k for k, v in a_model.get_vocab().items()}, alignment.byte_letters()
    docs = []
    for text in texts:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        own = [bytes(letters[c] for c in entry[i]) for i in a]
        other = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_model.id_to_piece, b))]
        if not text or b"".join(own) != (" " + text).encode() or b"".join(other) != (" " + text).encode():
            docs.append([])
            continue
        ends = [list(np.cumsum([len(x) for x in xs])) for xs in (own, other)]
        cuts, before, groups = sorted(set(ends[0]) & set(ends[1])), 0, []
        for cut in cuts:
            groups.append(tuple([i for i, e in zip(ids, end) if before < e <= cut] for ids, end in ((a, ends[0]), (b, ends[1]))))
            before = cut
        docs.append(groups)
    linked = [[(x, y) for a, b in groups for x in a for y in b] for groups in docs]
    held = collections.Counter(pair for links in linked for pair in set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest(g))
        for g, links in zip(docs, linked, strict=True)
    ]


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 50])
def test_alignment_by_hand(spark, chunk, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 4)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in [*CLASHES, "pair", "pairs", "links", "docs", "best", "part", "cut"]))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = {r["id"]: tuple(r[c] for c in names) for r in alignment.align(rows, *PATHS, chunk=chunk).collect()}
    assert [found[i] for i in range(len(TEXTS))] == plain_alignment(TEXTS)
    assert found[3] == found[4] == (0, 0, 0, 0, 0, 0, "") and found[9][0] > 5


def test_words_met_before_are_not_tokenized_again(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 40 * alignment.ENTRY)
    tokenizers, rng = alignment.Tokenizers(*PATHS), random.Random(3)
    plain, asked = tokenizers.b, []

    class Counted:
        def encode(self, text, **options):
            asked.append(text)
            return plain.encode(text, **options)

    tokenizers.b = Counted()
    some = ["a", "the", "cat\n", "\nno", "'s", "é①", "▁x", "<0x0A>", "</s>", "\x1c", "\x85", "　", "12", "x" * 70, "", "\0"]
    for text in TEXTS + [" ".join(rng.choices(some, k=rng.randint(1, 9))) for _ in range(2_000)]:
        if text:
            ids, found = plain.encode(text), tokenizers.tokens(text)
            exact = b"".join(tokenizers.bytes_b[i] for i in ids) == (" " + text).encode()
            assert (found is not None) == exact and (not exact or found[1].tolist() == ids)
    tokenizers.tokens("a cat sat there")
    asked.clear()
    assert tokenizers.tokens("the cat the") is not None and tokenizers.tokens("the cat the") is not None
    assert sum(map(len, asked)) < 2 * len("the cat the") and len(tokenizers.kept) <= 40


def test_pairs_beyond_the_broadcast_are_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    whole = sorted(map(tuple, alignment.align(rows, *PATHS).collect()))
    monkeypatch.setattr(alignment, "HOT", 20)
    assert sorted(map(tuple, alignment.align(rows, *PATHS).collect())) == whole


def test_a_large_group_is_linked_whole():
    monoid = alignment.Monoid(alignment.Tokenizers(*PATHS))
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50, 900).astype("i4"), r.integers(0, 70, 800).astype("i4")
    codes, links = alignment.summed(monoid.links(a, np.zeros(900, int), b, np.zeros(800, int), 1))
    want = collections.Counter(int(x) * monoid.base + int(y) for x in a for y in b)
    assert dict(zip(codes.tolist(), links.tolist())) == want


def test_composition_is_associative():
    tokenizers = alignment.Tokenizers(*PATHS)
    monoid = alignment.Monoid(tokenizers)
    a, b = tokenizers.tokens("unbelievable antidisestablishment, 日本語 and 😀 " * 20)
    at = [np.cumsum(w) - w for w in (tokenizers.width_a[a], tokenizers.width_b[b])]
    end = int(at[0][-1]) + 1

    def between(low, high):
        i, j = (slice(*np.searchsorted(s, (low, high))) for s in at)
        return monoid.fragment(a[i], at[0][i], b[j], at[1][j])

    show = lambda f: ([x.tolist() for x in f.prefix], f.suffix and [x.tolist() for x in f.suffix], b"".join(f.text), f.groups, [x.tolist() for x in alignment.summed(f.pairs)])
    whole = show(between(0, end + 99))
    for p, q in [(3, 7), (10, 11), (50, 400), (333, 334)]:
        x, y, z = between(0, p), between(p, q), between(q, end + 99)
        assert show(monoid.composed([monoid.composed([x, y]), z])) == show(monoid.composed([x, monoid.composed([y, z])])) == show(monoid.composed([x, y, z])) == whole


def test_alignment_of_nothing_and_of_repeated_ids(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    rows = spark.createDataFrame([(1, "The cat."), (1, "The cat."), (None, "The cat.")], "doc_id long, text string")
    found = alignment.align(rows, *PATHS).collect()
    assert sorted(str(r["id"]) for r in found) == ["1", "1", "None"]
    assert len({tuple(r)[1:] for r in found}) == 1 and found[0]["count_sum"] == 3 * found[0]["n_links"]


# ---- sharding


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_walked_is_a_permutation(rows):
    at = sharding.walked(np.arange(rows), rows, 13)
    assert sorted(at.tolist()) == list(range(rows))
    assert (sharding.walked(at, rows, 13, back=True) == np.arange(rows)).all()
    assert rows < 100 or (at != sharding.walked(np.arange(rows), rows, 14)).mean() > 0.9
    shard, slot = sharding.place_of(rows - 1, rows, 3)
    assert sharding.row_at(slot * 3 + shard, rows) == rows - 1


def test_the_permutation_mixes():
    at = sharding.walked(np.arange(10_000), 10_000, 13)
    assert abs(np.corrcoef(np.arange(10_000), at)[0, 1]) < 0.05
    counts = np.bincount(at[:1000] * 10 // 10_000)  # neighbours are spread
    assert counts.min() > 60 and counts.max() < 140


DOCS = [(i, f"text {i}") for i in range(200)] + [(None, None), (None, ""), (None, "x"), (7, "é" * 100_000), (7, "text 7")] + [(8, "same")] * 300


def test_shards_are_reproducible_and_even(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    clash = [F.lit("clash").alias(c) for c in [*CLASHES, "shard", "slot", "row", "copies", "first", "before", "digest"] if c != "id"]
    df = spark.createDataFrame(DOCS, "doc_id long, text string").select("*", *clash)
    found = sharding.shard_rows(df.repartition(7), 24).collect()
    again = sharding.shard_rows(df.coalesce(1), 24).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert sorted((str(r["id"]), r["text_crc32"], r["size"]) for r in found) == sorted((str(i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in DOCS)
    counts = collections.Counter(r["shard"] for r in found)
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))
    order = lambda r: (r["id"] is not None, r["id"] or 0, r["digest"])
    assert [r["row"] for r in sorted(found, key=lambda r: (*order(r), r["row"]))] == list(range(len(DOCS)))
    assert all(sharding.place_of(r["row"], len(DOCS), 24) == (r["shard"], r["slot"]) for r in found)


def test_shards_as_files(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    sharding.write_shards(df, f"{tmp_path}/s", 3)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((str(r["id"]), r["text"] or "") for r in back.collect()) == sorted((str(i), t or "") for i, t in DOCS)
    want = {(str(r["id"]), r["shard"], r["slot"]) for r in sharding.shard_rows(df, 3).collect()}
    assert {(str(r["id"]), r["shard"], r["slot"]) for r in back.collect()} == want


def test_shards_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_rows(empty, 24).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(empty, 0)
