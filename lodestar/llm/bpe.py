"""BPE encoding and decoding by speculation and verification.

Each new word is cut greedily into the longest tokens. Vectorised checks then test every pair of neighbours for a merge
that exact merging would have made across their border; words that pass have their exact encoding already, as tokens
stay whole and no border is crossed. Only words that fail are merged exactly. Words are remembered up to a bound.

Exact merging of a word of n characters takes n log n steps, so very long words and texts are encoded whole; a text and its
tokens are in the memory of one task. Equal rules are applied from the left. No rows give none.

Null texts count as empty: no tokens, empty decoded text. Special strings in a text become their ids. Repeated rows are
encoded one by one; other columns pass through `tokenise` untouched, and clashing columns are replaced by its own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, struct, texts_of

#: Texts of these characters are normalised alike by Python and by the tokenizer's own normaliser.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*")
#: Stands for the end of a word; no mapped byte has this character.
END = chr(0xE000)
#: Words that a worker remembers, in two generations: what the older one holds and no text asks for again is forgotten.
#: Fewer take less memory and more time; the results are the same.
REMEMBERED = 600_000
NEVER = 1 << 30


def byte_characters() -> list[str]:
    """The visible character of each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Bpe:
    """A word-end BPE vocabulary compiled to arrays. `definition` is the text of a tokenizer's JSON file."""

    def __init__(self, definition: str, remembered: int = REMEMBERED) -> None:
        spec, self.remembered = json.loads(definition), remembered
        model, self.definition = spec["model"], definition
        self.end = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max(*vocabulary.values(), *self.special.values()) + 1
        self.names = [""] * n
        for name, i in (vocabulary | self.special).items():
            self.names[i] = name
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = vocabulary[a], vocabulary[b]
            made = vocabulary[a + b]
            self.merge_of[x, y] = (k, made)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, k
        keys = np.array([x * n + y for x, y in self.merge_of], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array([k for k, _ in self.merge_of.values()])[order]
        chars = byte_characters()
        self.byte_ids = [vocabulary[c] for c in chars]
        self.end_ids = [vocabulary[c + self.end] for c in chars]
        self.chars = chars
        #: Tokens that exact merging gives back for their own characters, by their characters; the others are never proposed.
        single = {vocabulary[c] for c in chars} | {vocabulary[c + self.end] for c in chars}
        self.whole: dict[str, int] = {}
        backwards = {c: b for b, c in enumerate(chars)}
        for name, i in vocabulary.items():
            last = name.endswith(self.end) and len(name) > len(self.end)
            body = name[: -len(self.end)] if last else name
            ids = [self.byte_ids[backwards[c]] for c in body]
            if last:
                ids[-1] = self.end_ids[backwards[body[-1]]]
            if i in single or self.merged(ids) == [i]:
                self.whole[body + END if last else body] = i
        self.longest = max(map(len, self.whole))
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Ids of words, as little-endian unsigned 32-bit integers.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.library = None
        self.failed = 0

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging: the earliest rule first, from the left; pairs wait in a heap and parts in a linked list."""
        ids, n = list(ids), len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rule = self.merge_of
        waiting = [(found[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := rule.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)
        while waiting:
            _, i, x, y = heapq.heappop(waiting)
            j = after[i]
            if j < 0 or ids[i] != x or ids[j] != y:
                continue  # one of the two has been used up
            ids[i], ids[j] = rule[x, y][1], -1
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if found := rule.get((ids[i], ids[k])):
                    heapq.heappush(waiting, (found[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (found := rule.get((ids[h], ids[i]))):
                heapq.heappush(waiting, (found[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def base(self, word: str) -> list[int]:
        data = word.encode()
        return [*(self.byte_ids[b] for b in data[:-1]), self.end_ids[data[-1]]]

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match over the word's characters."""
        s, at, out = "".join([self.chars[b] for b in word.encode()]) + END, 0, []
        while at < len(s):
            for stop in range(min(len(s), at + self.longest), at, -1):
                i = self.whole.get(s[at:stop]) if stop != len(s) - 1 else None  # the last character goes with the end
                if i is not None:
                    out.append(i)
                    at = stop
                    break
            else:
                raise ValueError(f"no token starts at {s[at:]!r}")
        return out

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) * len(self.names) + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether no merge ever crosses their border.

        Both tokens are taken apart, latest merge first. Two parts that lie at the border at the same time merge across
        it if their rule comes before the rules that use them up; on a tie the left of two equal merges goes first.
        """
        good = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        until_x, until_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            m = self.pair_rank(x, y)
            crossed = (m < until_x) & (m <= until_y) & (m < NEVER)
            good[at[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y, until_x, until_y = at[go], x[go], y[go], until_x[go], until_y[go]
            on_left = self.rank[x] > self.rank[y]
            until_x, until_y = np.where(on_left, self.rank[x], until_x), np.where(on_left, until_y, self.rank[y])
            x, y = np.where(on_left, self.right[x], x), np.where(on_left, y, self.left[y])
        return good

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are not remembered yet; afterwards `known` has all the words."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.remembered // 2:
            self.older, self.known, new = self.known, {}, list(words)
        self.known.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in self.known]
        if not new:
            return
        guesses = [self.proposed(w) for w in new]
        flat = np.fromiter((i for g in guesses for i in g), np.int64)
        owner = np.repeat(np.arange(len(new)), [len(g) for g in guesses])
        inside = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inside] * len(self.names) + flat[1:][inside], return_inverse=True)
        good = self.compatible(pairs // len(self.names), pairs % len(self.names))
        bad = set(np.unique(owner[1:][inside][~good[back]]).tolist())
        self.failed += len(bad)
        data, start = flat.astype("<u4").tobytes(), 0
        for k, (w, g) in enumerate(zip(new, guesses, strict=True)):
            stop = start + 4 * len(g)
            self.known[w] = np.array(self.merged(self.base(w)), "<u4").tobytes() if k in bad else data[start:stop]
            start = stop

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.definition).normalizer
        return self.pattern.findall(self.library.normalize_str(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text, as little-endian unsigned 32-bit integers."""
        parts = []
        for t in texts:
            parts.append([(x, None) if x in self.special else (None, self.words(x)) for x in (self.cut.split(t) if self.cut else [t])])
        self.learn({w for p in parts for _, ws in p if ws for w in ws})
        out, known = [], self.known
        for p in parts:
            ids = [np.array([self.special[name]], "<u4").tobytes() if name is not None else b"".join(map(known.__getitem__, ws)) for name, ws in p]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def decode(self, ids) -> str:
        """The tokens' names between blanks, as a tokenizer without a decoder does."""
        return " ".join([self.names[i] for i in ids])


def load(spark, path: str, remembered: int = REMEMBERED):
    """The vocabulary, compiled on the driver and broadcast: as large as its file, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Bpe(f.read(), remembered))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _slices(texts: list[str], characters: int = 500_000):
    """Runs of texts of bounded total length, so that a batch of long texts needs little memory at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > characters:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    yield texts[start:]


def tokenise(docs: DataFrame, path: str | None = None, text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Adds ids array<int> and decoded string."""
    bpe = load(docs.sparkSession, path or default_path(), remembered)
    kept = docs.drop("ids", "decoded")

    def run(batch):
        machine = bpe.value
        ids = [x for part in _slices(texts_of(batch, text_col)) for x in machine.encode(part)]
        return {c: batch.column(c) for c in batch.schema.names} | {"ids": ids, "decoded": [machine.decode(x) for x in ids]}

    from pyspark.sql.types import StructType

    return map_arrow(kept, run, StructType(kept.schema.fields + struct("ids array<int>, decoded string").fields))


def digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; digests are taken where the ids are, so ids never leave the worker."""
    bpe = load(docs.sparkSession, path or default_path())

    def run(batch):
        machine, rows = bpe.value, []
        for part in _slices(texts_of(batch)):
            for ids in machine.encode(part):
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(machine.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows, strict=True)
        return {"doc_id": batch.column("doc_id"), "n_tokens": list(n), "ids_sha256": list(a), "decoded_sha256": list(b)}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, struct(f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
