"""Token counts by a byte-level BPE with word ends: words that are one token are looked up, only the others are merged."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 400_000      # merged words a task remembers
MEMO_LENGTH = 100   # longer ones are not remembered, and merged by a queue instead of a list
NO_RANK = (1 << 62, 0)
#: Pre-tokens of lower-case ASCII text, as the pattern of the tokenizer file gives them (checked by ``load``).
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


def byte_letters() -> list[str]:
    """The letter that stands for each byte value: itself where it prints, else the next one from U+0100 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass
class Merges:
    """What tasks need of a tokenizer file: its merges by pairs of ids, the words that are one token, and how texts are split."""

    inner: list[int]                            # byte value -> id inside a word
    final: list[int]                            # byte value -> id at a word's end
    rank: dict[tuple[int, int], tuple[int, int]]    # pair -> (rank, id of the merged token)
    whole: list[str]
    special: list[str]
    frame: str                                  # the tokenizer file without its vocabulary
    pattern: str

    def count(self, word: str) -> int:
        """Tokens of one pre-token: the pair of lowest rank is merged, of equal ones the leftmost, until none is left."""
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        if len(ids) > MEMO_LENGTH:
            return self.count_long(ids)
        get = self.rank.get
        found = [get(pair, NO_RANK) for pair in zip(ids, ids[1:])]
        while found and (low := min(found)) is not NO_RANK:
            i = found.index(low)
            ids[i:i + 2] = [low[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), NO_RANK)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), NO_RANK)
        return len(ids)

    def count_long(self, ids: list[int]) -> int:
        """The same for long words, in O(n log n) steps by a queue of pairs."""
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(*found, i, i + 1) for i in range(len(ids) - 1) if (found := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        n = len(ids)
        while heap:
            _, new, i, j = heapq.heappop(heap)
            if ids[i] < 0 or right[i] != j or self.rank.get((ids[i], ids[j]), (0, -1))[1] != new:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], right[i] = new, -1, right[j]
            n -= 1
            if right[i] < len(ids):
                left[right[i]] = i
                if found := self.rank.get((new, ids[right[i]])):
                    heapq.heappush(heap, (*found, i, right[i]))
            if left[i] >= 0 and (found := self.rank.get((ids[left[i]], new))):
                heapq.heappush(heap, (*found, left[i], i))
        return n


def load(path: str) -> Merges:
    """Read a tokenizer file where the job is planned, and prove which of its word-final strings encode alone as one token.

    A string is proved by merging it: the merges of a pre-token depend on nothing else, so a pre-token equal to a proved
    string is one token wherever it stands.  Files of another make (other models, padded special tokens, a
    different split of ASCII text) raise ValueError instead of being counted wrongly.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"].get("end_of_word_suffix")
    odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if (model["type"] != "BPE" or not end or model.get("ignore_merges") or model.get("dropout") or odd or len(steps) != 2
            or steps[0]["type"] != "Split" or steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"]):
        raise ValueError(f"{path} is no byte-level BPE with word ends")
    vocab, letters = model["vocab"], byte_letters()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
    merges = Merges([vocab[c] for c in letters], [vocab[c + end] for c in letters], rank, [],
                    [t["content"] for t in spec["added_tokens"]],
                    json.dumps({**spec, "model": {**model, "vocab": {}, "merges": []}}), steps[0]["pattern"]["Regex"])
    value = {c: b for b, c in enumerate(letters)}
    for name in vocab:
        if name.endswith(end):
            try:
                word = bytes(value[c] for c in name[:-len(end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and merges.count(word) == 1:
                merges.whole.append(word)
    splitter = Splitter(merges)
    probe = "".join(map(chr, range(32, 127))) + " it's we'll 'd 12ab''t"
    if splitter.by_library(probe) != splitter.plain(probe):
        raise ValueError(f"{path} splits plain text in another way")
    return merges


class Splitter:
    """Pre-tokens of texts.  ASCII texts need no library; others are normalised by it, and split by it where its
    character classes differ from those of ``regex`` for one of the characters, which is tried once per character."""

    def __init__(self, merges: Merges):
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers import Regex as Pattern

        self.normal = Tokenizer.from_str(merges.frame).normalizer
        self.split = pre_tokenizers.Split(Pattern(merges.pattern), behavior="removed", invert=True)
        self.pattern = regex.compile(merges.pattern)
        self.agrees: dict[str, bool] = {}

    def plain(self, text: str) -> list[str]:
        return ASCII.findall(text.lower())

    def by_library(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [p for p, _ in self.split.pre_tokenize_str(text)]

    def same(self, c: str) -> bool:
        if c not in self.agrees:
            probe = f"a{c}!{c}1{c}a"
            self.agrees[c] = [p for p, _ in self.split.pre_tokenize_str(probe)] == self.pattern.findall(probe)
        return self.agrees[c]

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain(text)
        text = self.normal.normalize_str(text) if self.normal else text
        if all(map(self.same, set(text))):
            return self.pattern.findall(text)
        return [p for p, _ in self.split.pre_tokenize_str(text)]


class Counts(dict):
    """Tokens per pre-token: one for the proved ones, the others are merged when they first occur."""

    def __init__(self, merges: Merges):
        super().__init__(dict.fromkeys(merges.whole, 1))
        self.merges = merges

    def __missing__(self, word: str) -> int:
        n = self.merges.count(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO + len(self.merges.whole):
                self.clear()
                self.update(dict.fromkeys(self.merges.whole, 1))
            self[word] = n
        return n


class Counter:
    """Counts the tokens of texts; a special token of the file inside a text is one token, as by the library's default."""

    def __init__(self, merges: Merges):
        self.splitter, self.counts = Splitter(merges), Counts(merges)
        longest = sorted(merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if longest else None

    def __call__(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.splitter(p))) for p in parts if p)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text.

    Missing and empty texts have none, repeated rows stay rows of their own, and other columns are not read.  No row
    leaves its partition.  What tasks get is the tokenizer file's merges, whose size does not depend on the rows.
    """
    merges = load(path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = Counter(merges)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array([count(t) for t in texts], pa.int64())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
