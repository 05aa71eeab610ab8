"""Aligning two tokenizers: token groups by an associative monoid of fragments.

Where a token of A and one of B begin at the same byte, the text is cut; tokens between two cuts are a
group, and a group's tokens of A are linked to those of B. A byte range of a text gives a fragment: an open
prefix (tokens before its first cut), closed groups, and an open suffix (tokens from its last cut
on). Fragments of neighbouring ranges compose: the suffix of one and the prefix of the next are a
group between them. Composition is associative, so fragments of a very long document are made by many
tasks and composed in a tree; a short document is one fragment.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a fragment. Documents up to this size are one.
CHUNK = 1 << 17
#: Fragments that are composed at once.
FAN = 16
#: Fixed value: how a byte-level tokenizer splits a text into the parts that it merges within.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links that are listed at once.
BLOCK = 1 << 20
#: Pairs with the most documents that are broadcast; no other pair has more than this share of all rows.
HOT = 50_000
#: Characters of words whose tokens a worker keeps at most, each with so many more for its entry.
KEPT, ENTRY = 1 << 23, 64
#: A space that no word follows, and one before the first word.
LOOSE = re.compile(r"(?:^| )(?= |\Z)")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable Latin-1 bytes are themselves, others follow from U+0100."""
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def by_ranks(stated: dict, letters: dict[str, int]):
    """A quicker encoder with the same tokens, where the tokenizer file has nothing but a byte-level BPE whose entries are in the
    order of its merges; None for other files. PATTERN is the one that a byte-level tokenizer splits by."""
    import tiktoken

    model, plain = stated["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    if len(letters.keys() & model["vocab"].keys()) < 256:
        return None
    if stated["normalizer"] or not plain.items() <= (stated["pre_tokenizer"] or {}).items() or model["type"] != "BPE" or None in made or made != sorted(made):
        return None
    special = {t["content"] for t in stated["added_tokens"]}
    ranks = {bytes(letters[c] for c in entry): i for entry, i in model["vocab"].items() if entry not in special}
    return tiktoken.Encoding("by_ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_spaces(path: str, pieces: list[str]) -> bool:
    """Whether a piece tokenizer takes texts as they are, with a space before them, and merges nothing over the beginning of a space."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    own, bpe = model.normalizer_spec, model.trainer_spec.model_type == model.trainer_spec.BPE
    as_is = own.name == "identity" and not own.precompiled_charsmap and own.add_dummy_prefix and own.escape_whitespaces and not own.remove_extra_whitespaces
    return bpe and as_is and not model.trainer_spec.treat_whitespace_as_suffix and all("\u2581" not in p.lstrip("\u2581") for p in pieces)


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        letters = byte_letters()
        entries = dict(map(reversed, self.a.get_vocab().items()))
        self.bytes_a = [bytes(letters.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.fast_a = by_ranks(json.loads(self.a.to_str()), letters)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # the tokens of words, as bytes of 32-bit ids, where B takes each word by itself
        self.by_words, self.kept, self.held = plain_spaces(path_b, pieces), {}, 0
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # decimal digits of ids behind zeros, and a place for the mark behind them
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        width = len(names[-1])
        self.digits = np.frombuffer(b"".join(n.rjust(width, b"\0") + b"\0" for n in names), np.uint8).reshape(-1, width + 1)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of blank + text by A and of text by B; None where either's bytes aren't blank + text."""
        if not text:
            return None
        if self.fast_a:  # it takes bytes apart and nothing else
            own = self.fast_a.encode_to_numpy(" " + text, disallowed_special=()).view(np.int32)
        else:
            ids = self.a.encode(" " + text, add_special_tokens=False).ids
            if b"".join(map(self.bytes_a.__getitem__, ids)) != (" " + text).encode():
                return None
            own = np.array(ids, np.int32)
        other = self.words_of_b(text) if self.by_words and not LOOSE.search(text) else self.text_of_b(text)
        return None if other is None else (own, other)

    def text_of_b(self, text: str) -> np.ndarray | None:
        """The ids of text by B; None where their bytes aren't blank + text."""
        ids = self.b.encode(text, num_threads=1)
        return np.array(ids, np.int32) if b"".join(map(self.bytes_b.__getitem__, ids)) == (" " + text).encode() else None

    def words_of_b(self, text: str) -> np.ndarray | None:
        """text_of_b(), where words that were met before aren't tokenized again: no token of B lies over the beginning of a space."""
        words = text.split(" ")
        new = list({*words}.difference(self.kept))
        if new:
            ids = self.text_of_b(" ".join(new))
            if ids is None:
                return None
            ends = np.cumsum([len(w.encode()) + 1 for w in new])
            cuts, own = ((np.searchsorted(np.cumsum(self.width_b[ids]), ends) + 1) * ids.itemsize).tolist(), ids.tobytes()
            self.kept.update(zip(new, [own[i:j] for i, j in zip([0, *cuts], cuts)], strict=True))  # noqa: B905
        out = np.frombuffer(b"".join(map(self.kept.__getitem__, words)), np.int32)
        size = sum(map(len, new)) + ENTRY * len(new)
        if new and self.held + size > KEPT:
            for w in new:
                del self.kept[w]
        elif new:
            self.held += size
        return out

    def group_text(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int) -> bytes:
        """`a1,a2|b1;a3|b2,b3;`: the ids of groups 0 to groups - 1, all closed by a semicolon."""
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        ids, marks = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + (ends_b - n_b)[group_a]] = a
        ids[np.arange(len(b)) + ends_a[group_b]] = b
        marks[ends_a + ends_b - n_b - 1] = ord("|")
        marks[ends_a + ends_b - 1] = ord(";")
        out = self.digits[ids]
        out[:, -1] = marks
        return out[out > 0].tobytes()


@dataclass
class Fragment:
    """Tokens of a byte range: (A ids, B ids) before the first cut, closed groups, and from the last cut on. No cut: all is prefix."""

    prefix: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray] | None = None
    text: list[bytes] = field(default_factory=list)
    groups: int = 0
    pairs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes, numbers of links): each code once, with the sum of its links."""
    if len(pairs) < 2:
        return pairs[0] if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes, at = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, np.concatenate([n for _, n in pairs]))
    return codes, sums


class Monoid:
    """Fragments of token runs, and their composition."""

    def __init__(self, tokenizers: Tokenizers):
        self.t, self.base = tokenizers, len(tokenizers.bytes_b)

    def links(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(codes, links) of groups 0 to groups - 1; a code is A id * size of B's vocabulary + B id."""
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        out, size = [], n_a * n_b
        large = np.flatnonzero(size > BLOCK // 16)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        for g in large:  # each id of a large group once
            ids_a, m_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            ids_b, m_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            rows = max(1, BLOCK // len(ids_b))
            for k in range(0, len(ids_a), rows):
                out.append(((ids_a[k : k + rows, None].astype(np.int64) * self.base + ids_b).ravel(), (m_a[k : k + rows, None] * m_b).ravel()))
        size[large] = 0
        times = np.where(size > 0, n_b, 0)[group_a]
        ends = np.cumsum(times)
        at, before = 0, 0
        while at < len(a):
            end = max(at + 1, int(np.searchsorted(ends, before + BLOCK)))
            own = times[at:end]
            left = np.repeat(np.arange(at, end), own)
            nth = np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
            out.append(np.unique(a[left].astype(np.int64) * self.base + b[first_b[group_a[left]] + nth], return_counts=True))
            before, at = int(ends[end - 1]), end
        return out

    def fragment(self, a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, ends: bool = False) -> Fragment:
        """The fragment of tokens that begin in a byte range, with the bytes where they begin. ends: the range's end is a cut."""
        # marks of the bytes where tokens begin tell which of the other's begin there too
        first = min(x[0] for x in (start_a, start_b) if len(x)) if len(a) or len(b) else 0
        marks = np.zeros((2, max(x[-1] for x in (start_a, start_b) if len(x)) - first + 1 if len(a) or len(b) else 0), bool)
        at_a, at_b = start_a - first, start_b - first
        marks[0, at_a], marks[1, at_b] = True, True
        group_a, group_b = np.cumsum(marks[1, at_a]), np.cumsum(marks[0, at_b])
        run = lambda low, high: (slice(*np.searchsorted(group_a, (low, high))), slice(*np.searchsorted(group_b, (low, high))))
        of = lambda s: (a[s[0]], b[s[1]])
        last = int(group_a[-1]) if len(a) else 0
        if not last:
            return Fragment((a, b))
        groups = last if ends else last - 1
        inner = run(1, groups + 1)
        out = Fragment(of(run(0, 1)), of(run(groups + 1, last + 1)), groups=groups)
        if groups:
            ids, own = of(inner), (group_a[inner[0]] - 1, group_b[inner[1]] - 1)
            out.text.append(self.t.group_text(ids[0], own[0], ids[1], own[1], groups))
            out.pairs = self.links(ids[0], own[0], ids[1], own[1], groups)
        return out

    def group(self, into: Fragment, a: np.ndarray, b: np.ndarray) -> None:
        """Adds one closed group."""
        zeros = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        into.text.append(self.t.group_text(a, zeros[0], b, zeros[1], 1))
        into.pairs += self.links(a, zeros[0], b, zeros[1], 1)
        into.groups += 1

    def composed(self, fragments: list[Fragment]) -> Fragment:
        """Neighbouring fragments as one."""
        join = lambda x, y: tuple(np.concatenate(p) for p in zip(x, y, strict=True))
        out, *rest = fragments
        out = Fragment(out.prefix, out.suffix, list(out.text), out.groups, list(out.pairs))
        for f in rest:
            if out.suffix is None:
                out.prefix, out.suffix = join(out.prefix, f.prefix), f.suffix
            elif f.suffix is None:
                out.suffix = join(out.suffix, f.prefix)
                continue
            else:
                self.group(out, *join(out.suffix, f.prefix))
                out.suffix = f.suffix
            out.text += f.text
            out.groups += f.groups
            out.pairs += f.pairs
        return out

    def closed(self, f: Fragment) -> Fragment:
        """The fragment of a whole text: its end is a cut, as its beginning is."""
        out = self.composed([f])
        if out.suffix is not None and len(out.suffix[0]):
            self.group(out, *out.suffix)
        return out


#: A stored row: a chunk's tokens (a, b, and the bytes where its first ones begin) where parts > 1, a whole document's findings else.
FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
CHUNKS = f"row long, id string, part int, parts int, at_a long, at_b long, a array<int>, b array<int>, {FOUND}"
DONE = f"row long, id string, {FOUND}"
#: A fragment in a frame.
FRAGMENT = "row long, id string, part int, n_a long, n_b long, a0 array<int>, b0 array<int>, cut boolean, a1 array<int>, b1 array<int>, groups string, n_groups long, pairs array<long>, links array<long>"


def findings(f: Fragment, n_a: int, n_b: int) -> tuple:
    """FOUND of a closed fragment."""
    codes, links = summed(f.pairs)
    return n_a, n_b, f.groups, int(links.sum()), hashlib.sha256(b"".join(f.text)[:-1]).hexdigest(), codes, links


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs -> (row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links), a row for each of its rows; row is a number of its own.

    pairs holds the codes (A id * size of B's vocabulary + B id) that the document has linked, links how
    often. A text that is null or empty, or whose tokens' bytes aren't blank + text in either tokenizer,
    has zeros, no pairs and an empty digest. Ids may be null and of any type; other columns are ignored.
    """
    held: list[Monoid] = []

    def monoid() -> Monoid:
        if not held:
            held.append(Monoid(Tokenizers(path_a, path_b)))
        return held[0]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, none = monoid(), []
        for batch in batches:
            rows, n = [], 0
            for row, name, text in zip(batch["row"], batch["id"].array, batch["text"], strict=True):
                found = m.t.tokens(text)
                if found is None:
                    rows.append((row, name, 0, 1, 0, 0, none, none, 0, 0, 0, 0, "", none, none))
                    continue
                a, b = found
                starts = [np.cumsum(w) - w for w in (m.t.width_a[a], m.t.width_b[b])]
                parts = int(starts[0][-1]) // chunk + 1
                if parts == 1:
                    whole = m.fragment(a, starts[0], b, starts[1], ends=True)
                    rows.append((row, name, 0, 1, 0, 0, none, none, *findings(whole, len(a), len(b))))
                else:
                    bounds = [np.searchsorted(s, np.arange(parts + 1) * chunk) for s in starts]
                    bounds[1][-1] = len(b)
                    for k in range(parts):
                        (i, j), (x, y) = bounds[0][k : k + 2], bounds[1][k : k + 2]
                        at = [int(s[p]) if p < len(s) else 0 for s, p in ((starts[0], i), (starts[1], x))]
                        rows.append((row, name, k, parts, *at, a[i:j], b[x:y], j - i, y - x, 0, 0, "", none, none))
                n += len(a)
                if n >= 1 << 19:
                    yield frame(rows, CHUNKS)
                    rows, n = [], 0
            yield frame(rows, CHUNKS)

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = monoid()
        for batch in batches:
            for r in batch.itertuples():
                a, b = np.asarray(r.a, np.int32), np.asarray(r.b, np.int32)
                starts = [at + np.cumsum(w) - w for at, w in ((r.at_a, m.t.width_a[a]), (r.at_b, m.t.width_b[b]))]
                yield frame([(r.row, r.id, r.part, len(a), len(b), *unpacked(m.fragment(a, starts[0], b, starts[1])))], FRAGMENT)

    def composed(rows: pd.DataFrame) -> tuple[Fragment, int, int]:
        rows = rows.sort_values("part")
        return monoid().composed([packed(r) for r in rows.itertuples()]), int(rows["n_a"].sum()), int(rows["n_b"].sum())

    def one_up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f, n_a, n_b = composed(rows)
        return frame([(key[0], rows["id"].iloc[0], key[1], n_a, n_b, *unpacked(f))], FRAGMENT)

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f, n_a, n_b = composed(rows)
        return frame([(key[0], rows["id"].iloc[0], *findings(monoid().closed(f), n_a, n_b))], DONE)

    # ids go through pandas as text, as a batch of numbers with a null would become floating
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found, _ = stored(rows.mapInPandas(cut, CHUNKS), "aligned")
    most = found.agg(F.max("parts")).first()[0] or 1
    out = found.where("parts = 1").select(*(c.split()[0] for c in DONE.split(", ")))
    if most > 1:
        level = found.where("parts > 1").select("row", "id", "part", "at_a", "at_b", "a", "b").repartition("row", "part").mapInPandas(fragments, FRAGMENT)
        up = F.floor(F.col("part") / FAN).cast("int").alias("part")
        while most > FAN:
            level, most = level.groupBy("row", up).applyInPandas(one_up, FRAGMENT), -(-most // FAN)
        long, _ = stored(level.groupBy("row").applyInPandas(top, DONE), "aligned-long")
        out = out.unionByName(long)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def unpacked(f: Fragment) -> tuple:
    """A fragment as FRAGMENT has it, behind the counts of tokens."""
    codes, links = summed(f.pairs)
    a1, b1 = f.suffix if f.suffix is not None else (f.prefix[0][:0], f.prefix[1][:0])
    return *f.prefix, f.suffix is not None, a1, b1, b"".join(f.text).decode(), f.groups, codes, links


def packed(r) -> Fragment:
    """A row of FRAGMENT as a fragment."""
    ids = lambda x: np.asarray(x, np.int32)
    pairs = (np.asarray(r.pairs, np.int64), np.asarray(r.links, np.int64))
    return Fragment((ids(r.a0), ids(r.b0)), (ids(r.a1), ids(r.b1)) if r.cut else None, [r.groups.encode()], int(r.n_groups), [pairs])


def pair_counts(found: DataFrame, base: int) -> DataFrame:
    """aligned() -> (pair, a, b, docs, best): how many documents hold a pair linked, and whether no pair of its A id is in more."""
    counted = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counted, _ = stored(counted.withColumn("a", F.floor(F.col("pair") / base)), "pairs")
    most = counted.groupBy("a").agg(F.max("docs").alias("most"))
    return counted.join(most, "a").select("pair", "a", (F.col("pair") % base).alias("b"), "docs", (F.col("docs") == F.col("most")).alias("best"))


def corpus_links(found: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """aligned() and pair_counts() -> (row, n_best, count_sum) for rows with links.

    total: rows of all documents' pairs, so fewer than HOT pairs are in more than total / HOT documents.
    Those are broadcast; for the others, which are in few documents each, rows are shuffled.
    """
    sums = (F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    rows = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    marked = counts.select("pair", "docs", "best")
    hot = marked.where(F.col("docs") > total / HOT)
    near = rows.join(F.broadcast(hot), "pair", "left")
    first = near.where("docs is not null").groupBy("row").agg(*sums)
    rest = near.where("docs is null").select("pair", "row", "links").join(marked.where(F.col("docs") <= total / HOT), "pair").groupBy("row").agg(*sums)
    return first.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs -> (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each of its rows.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the sum over
    links of their pair's documents. A row counts as a document, so equal rows count each. See aligned().
    """
    found, _ = stored(aligned(docs, path_a, path_b, id_col, text_col, chunk), "aligned-docs")
    counts, _ = stored(pair_counts(found, vocabulary_size(path_b)), "pair-counts")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    sums = corpus_links(found, counts, total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def vocabulary_size(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).vocab_size()
