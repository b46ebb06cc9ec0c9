"""BPE encoding and decoding with a public vocabulary whose words end in a suffix, long texts by tree concatenation.

Words: texts of common signs (COMMON) are lower-cased and split by the tokenizer's own rule here; each different word is encoded once
by a worker and kept in a bounded table. Any other text goes through the library, in pieces that end between words; one without white space or
signs that end a sentence or clause is one piece.

Trees: a text of more than `split_chars` characters is cut into pieces of about that size, encoded as rows of their own by any
executor, and put together again. A cut at white space separates words and needs no more. A text without white space is
cut inside a run of letters; the halves are encoded, then a window of k tokens on either side of the join is encoded anew, k
doubling until the window has a token in common with the left half and one with the right half (same place, same token). Adjacent tokens of
BPE depend on each other alone, so the tokens left of the first common token, the window's between them and those right
of the second are the encoding of the whole. Long single words inside a piece are treated the same way.

Defined results: a null text counts as empty: no tokens, empty decoded text; repeated rows are encoded one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT_CHARS, LEAF, MOST_WORDS = 32_768, 128, 250_000
#: Letters, numbers and white space as the tokenizer's rule sees them, up to U+017F.
_LETTERS, _NUMBERS, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
COMMON = re.compile("[\x00-įı-ſ‐-‧‰-⁞€]*")
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# where words of any script end: at white space, and behind these signs, which make no word with the letter or number that follows
CUT_ANY = re.compile(r"[\t-\r ]|(?<=[.,;:!?。，、！？；：])(?=[^\W_])")
CUT_AT = re.compile(rf"[{_SPACE}]|(?<=[A-Za-z]{{4}})(?=[A-Za-z])")
_codecs: dict[str, Codec] = {}


def is_common(text: str) -> bool:
    return "<|" not in text and (text.isascii() or COMMON.fullmatch(text) is not None)


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if prints(b) else chr(more))
        more += not prints(b)
    return out


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.end = model["end_of_word_suffix"]
        self.signs = byte_signs()
        self.known: dict[str, tuple[str, str]] = {}

    def symbols(self, text: str, ends: bool) -> list[str]:
        out = [self.signs[b] for b in text.encode()]
        if ends:
            out[-1] += self.end
        return out

    def merge(self, symbols: list[str]) -> list[tuple[str, int]]:
        """Tokens with the number of symbols of each; by a heap of merges, lowest rank first, leftmost first."""
        n = len(symbols)
        tok, size = list(symbols), [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if j >= n or tok[i] != a or tok[j] != b:
                continue
            tok[i], size[i], size[j] = a + b, size[i] + size[j], 0
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((tok[x], tok[y]))) is not None:
                    heapq.heappush(heap, (r, x, tok[x], tok[y]))
        return [(tok[i], size[i]) for i in range(n) if size[i]]

    def tree(self, symbols: list[str]) -> list[tuple[str, int]]:
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]), symbols)

    def join(self, left: list[tuple[str, int]], right: list[tuple[str, int]], symbols: list[str]) -> list[tuple[str, int]]:
        """symbols: those of left and right together."""
        middle, k = sum(n for _, n in left), 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            start = middle - sum(n for _, n in left[i:])
            stop = middle + sum(n for _, n in right[:j])
            window = self.merge(symbols[start:stop])
            olds, at = {}, start
            for x, (t, n) in enumerate(left[i:], i):
                olds[at, t, n] = x
                at += n
            news = {}
            for x, (t, n) in enumerate(right[:j]):
                news[at, t, n] = x
                at += n
            at, first, last = start, None, None
            for x, (t, n) in enumerate(window):
                if at + n <= middle and (at, t, n) in olds:
                    first = (olds[at, t, n], x)  # the last one that both have
                if last is None and at >= middle and (at, t, n) in news:
                    last = (news[at, t, n], x)
                at += n
            if i == 0 and first is None:
                first = (0, 0)
            if j == len(right) and last is None:
                last = (len(right), len(window))
            if first and last:
                return left[: first[0]] + window[first[1] : last[1]] + right[last[0] :]
            k *= 2

    def word(self, word: str) -> tuple[str, str]:
        """ids and tokens, each joined by spaces."""
        got = [t for t, _ in self.tree(self.symbols(word, True))]
        return " ".join(str(self.vocab[t]) for t in got), " ".join(got)

    def words(self, found: list[str]) -> tuple[str, str]:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        got = []
        for w in found:
            x = known.get(w)
            if x is None:
                x = self.word(w)
                if len(w) <= 64:
                    known[w] = x
            got.append(x)
        return " ".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def find(self, text: str) -> list[str]:
        return ASCII_WORD.findall(text.lower()) if text.isascii() else WORD.findall(text.lower())

    def encode(self, text: str) -> tuple[str, str]:
        """ids and decoded text of a whole text."""
        if is_common(text):
            return self.words(self.find(text))
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids, skip_special_tokens=False)

    def piece(self, text: str, open_left: bool, open_right: bool) -> tuple[str, list[str], str, list[str], bool]:
        """ids, tokens and the words that go on beyond the piece: (ids, head word, tokens, tail word, one word only)."""
        found = self.find(text)
        if len(found) == 1 and open_left and open_right:
            return "", found, "", [], True
        head = found[:1] if open_left else []
        tail = found[-1:] if open_right else []
        ids, names = self.words(found[len(head) : len(found) - len(tail)])
        return ids, head, names, tail, False


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def cut(text: str, size: int) -> list[tuple[str, bool, bool]]:
    """Pieces of a text with whether a word goes on before and after. Texts of other than common signs are cut between words only."""
    common = is_common(text)
    where = CUT_AT if common else CUT_ANY
    out, at, was = [], 0, False
    while at < len(text):
        m = where.search(text, min(at + size, len(text))) if len(text) - at > size else None
        stop = m.start() if m else len(text)
        goes_on = common and bool(m) and m.end() == m.start()
        out.append((text[at:stop], was, goes_on))
        at, was = stop, goes_on
    return out


def _digests(ids: str, decoded: str) -> tuple:
    return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _whole(ids: str, decoded: str) -> tuple:
    return [int(i) for i in ids.split()], decoded


DIGESTS = (_digests, ("n_tokens", "ids_sha256", "decoded_sha256"), "n_tokens long, ids_sha256 string, decoded_sha256 string")
WHOLE = (_whole, ("ids", "decoded"), "ids array<int>, decoded string")


def encode(docs: DataFrame, path: str, result: tuple[Callable, tuple, str] = WHOLE, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and what `result` makes of ids (joined by spaces) and decoded text."""
    import pandas as pd

    finish, names, kinds = result
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def table(ids: list, made: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64")})
        for k, n in enumerate(names):
            out[n] = [m[k] for m in made]
        return out

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            yield table(b["doc_id"], [finish(*c.encode(t)) for t in b["text"]])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for u, d, t in zip(b["uid"], b["doc_id"], b["text"], strict=True):
                made = cut(t, split_chars)
                yield pd.DataFrame({"uid": u, "doc_id": pd.array([d] * len(made), dtype="Int64"), "k": range(len(made)), "text": [x[0] for x in made], "l": [x[1] for x in made], "r": [x[2] for x in made]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in batches:
            out = []
            for t, is_open, goes_on in zip(b["text"], b["l"], b["r"], strict=True):
                if not (is_open or goes_on):
                    ids, names_ = c.encode(t)
                    out.append((ids, None, names_, None, None, None, False))
                    continue
                ids, head, toks, tail, one = c.piece(t, is_open, goes_on)
                made = []
                for w, ends in ((head, not one), (tail, False)):
                    got = c.tree(c.symbols(w[0], ends)) if w else None
                    made += [w[0] if w else None, json.dumps(got) if got is not None else None]
                out.append((ids, made[0], toks, made[2], made[1], made[3], one))
            yield pd.concat([b[["uid", "doc_id", "k"]].reset_index(drop=True), pd.DataFrame(out, columns=["ids", "head", "toks", "tail", "head_toks", "tail_toks", "one"])], axis=1)

    def together(b: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        ids, toks, open_ = [], [], []

        def close() -> None:
            """The pieces of one word, halves first."""
            if not open_:
                return

            def tree(a: int, z: int) -> tuple[list, list]:
                if z - a == 1:
                    return open_[a]
                (s, t), (u, v) = tree(a, (a + z) // 2), tree((a + z) // 2, z)
                return s + u, c.join(t, v, s + u)

            for t, _ in tree(0, len(open_))[1]:
                ids.append(str(c.vocab[t]))
                toks.append(t)
            open_.clear()

        load = lambda x: [tuple(y) for y in json.loads(x)]
        for r in b.sort_values("k").itertuples():
            if isinstance(r.head, str):
                open_.append((c.symbols(r.head, not r.one), load(r.head_toks)))
            if not r.one:
                close()
            if r.ids:
                ids.append(r.ids)
                toks.append(r.toks)
            if isinstance(r.tail, str):
                open_.append((c.symbols(r.tail, False), load(r.tail_toks)))
        close()
        return table([b["doc_id"].iloc[0]], [finish(" ".join(ids), " ".join(toks))])

    schema = f"doc_id long, {kinds}"
    small = rows.filter(F.char_length("text") <= split_chars).mapInPandas(short, schema)
    cut_up = rows.filter(F.char_length("text") > split_chars).withColumn("uid", F.monotonically_increasing_id())
    cut_up = cut_up.mapInPandas(pieces, "uid long, doc_id long, k int, text string, l boolean, r boolean")
    encoded = cut_up.repartition("uid", "k").mapInPandas(leaves, "uid long, doc_id long, k int, ids string, head string, toks string, tail string, head_toks string, tail_toks string, one boolean")
    return small.unionByName(encoded.groupBy("uid").applyInPandas(together, schema))
