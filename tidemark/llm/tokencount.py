"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The encoding of a prefix ends in exactly one token, and what precedes that token is the encoding of the shorter prefix before
it. So the last token of each prefix of a word follows from those of shorter prefixes: of the vocabulary's tokens that end
there, the one that is compatible with the last token before it, that is, whose concatenation with it BPE leaves
as the two. The count at a prefix is one more than at the prefix before its last token. Whether two tokens are compatible is
found once by merging their bytes, and kept.

Words come from the tokenizer's pattern; a text's counts are its words' counts added up. Prefix counts answer how
many tokens any prefix has and where a budget ends without encoding again.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import merge_long, merge_short
from tidemark.llm.rows import map_batches
from tidemark.llm.vocab import CACHE_CHARS, CACHE_WORDS, load, special_pattern

#: Fixed by byte-level BPE: contractions; letters, digits or other signs with a space before; white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pairs of tokens of which a worker keeps whether they are compatible.
CACHE_PAIRS = 1_000_000
SPACE = regex.compile(r"\s+")
LIMIT = 1024


class Totals(dict):
    """A piece to its tokens: the count at its longest prefix."""

    def __init__(self, counts: Counter):
        super().__init__()
        self.counts = counts

    def __missing__(self, piece: str) -> int:
        found = self.counts[piece][-1]
        if piece in self.counts:
            self[piece] = found
        return found


class Counter(dict):
    """A piece to its token counts at every prefix of its bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.path, self.vocab = path, load(path)
        self.longest = max(map(len, self.vocab.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.raw = {i: t for t, i in self.vocab.ids.items()}
        self.totals = Totals(self)

    def merged(self, raw: bytes) -> list[int]:
        parts = [self.vocab.first[b] for b in raw]
        return (merge_short if len(parts) <= 64 else merge_long)(parts, self.vocab)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two; a is -1 at the start of a piece."""
        if (known := self.pairs.get((a, b))) is None:
            known = self.merged(self.raw[b]) == [b] if a < 0 else self.merged(self.raw[a] + self.raw[b]) == [a, b]
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[a, b] = known
        return known

    def prefixes(self, raw: bytes) -> list[int]:
        """Token counts of raw[:0], raw[:1], ... raw[:n], raw being one piece."""
        ids, compatible, longest = self.vocab.ids.get, self.compatible, self.longest
        last, count = [-1], [0]
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - longest), end):
                token = ids(raw[start:end])
                if token is not None and compatible(last[start], token) and (start == 0 or last[start] >= 0):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return count

    def __missing__(self, piece: str) -> list[int]:
        found = self.prefixes(piece.encode("utf-8"))
        if len(self) < CACHE_WORDS and len(piece) <= CACHE_CHARS:
            self[piece] = found
        return found

    def total(self, piece: str) -> int:
        """Tokens of a piece."""
        return self.totals[piece]

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches between special strings, and those strings."""
        split = special_pattern(self.path)
        return [(x, bool(k % 2)) for k, x in enumerate(split.split(text) if split else [text])]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty."""
        look = self.totals.__getitem__
        return sum([1 if special else sum(map(look, PIECES.findall(part))) for part, special in self.parts(text or "")])

    def counts(self, text: str | None) -> list[int]:
        """Tokens of text[:0], text[:1], ... text[:n], each exactly as if that prefix were encoded alone."""
        out, done, tail, before = [0], 0, "", 0
        for part, special in self.parts(text or ""):
            if special:
                # Until a special string is complete, its beginning is ordinary text and joins the text before it.
                out += [before + sum(map(self.total, PIECES.findall(tail + part[:k]))) for k in range(1, len(part))] + [done + 1]
                done, tail, before = done + 1, "", done + 1
                continue
            base, blank, held = done, 0, 0  # held: where a run of white space began, and the count before it
            for m in PIECES.finditer(part):
                piece = m[0]
                inner = self[piece]
                at, blanks, after = 0, bool(SPACE.fullmatch(piece)), bool(m.start() and SPACE.fullmatch(part[m.start() - 1]))
                for k, letter in enumerate(piece, 1):
                    at += len(letter.encode("utf-8"))
                    if after and (k == 1 or blanks) and SPACE.fullmatch(piece[:k]):
                        # At the end of a text, all its white space is one piece, which the next letter may split.
                        tail = part[blank : m.start() + k]
                        out.append(held + sum(map(self.total, PIECES.findall(tail))))
                    elif k == 2 and len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
                        out.append(base + self.total("'") + self.total(piece[1]))  # half a contraction: a sign and a letter
                    else:
                        out.append(base + inner[at])
                if blanks and not after:
                    blank, held = m.start(), base
                if not blanks:
                    tail, before = "", base
                tail += piece
                base += inner[-1]
            done = base
        return out

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        counts = self.counts(text)
        return (text or "")[: max(k for k, n in enumerate(counts) if n <= max(0, budget))]


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, as the tokenizers library counts without added tokens.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are returned as they come. Other
    columns are not read; an empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path).count
        found = [count(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64()), pa.array([n > limit for n in found])], names=["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n")), work, "id long, n_bytes long, n_tokens long, over_limit boolean")


def truncated(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_chars): the longest prefix of each text within a token budget; a null text gives an empty one."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [counter(path).truncate(x, budget) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string()), pa.array(list(map(len, cut)), pa.int64())], names=["id", "text", "n_chars"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), work, "id long, text string, n_chars long")
