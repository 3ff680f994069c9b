"""Records that were cut off before their writer's end (problem 1).

A backward character model says, for the last characters of a text, how often texts of this corpus end there and how
often they go on. Names of programs, paths and numbers count as one symbol each, so the model learns the language
around them. What ends inside a fenced block or a key block is cut without asking the model.

Words, contexts and thresholds are counted over all texts: words by partial aggregation, contexts in arrays of fixed
size that tasks add up, thresholds from histograms of the held-out texts. What comes to the driver is as large for a
thousand texts as for a billion.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import is_blank
from mnemospark.llm import language
from mnemospark.llm.charlm import CharModel, TextScores
from mnemospark.llm.prose import prose_words
from mnemospark.storage import materialize

#: Lengths of the contexts, shortest first.
ORDERS = (1, 2, 3, 4, 6, 8, 11, 15, 20, 26)
#: Contexts seen less often are left to the next shorter one: a text's own end must not vouch for itself.
LEAST_SEEN = 2
#: Contexts of an order are counted in 2**BUCKET_BITS counters by their hash, summed in CHUNKS parts. A counter counts
#: only from NOISE times the mean of the counters below that on, so that what shares it by chance doesn't decide.
BUCKET_BITS, CHUNKS, NOISE = 20, 16, 4
#: Every HELD_OUT-th text, by the hash of its content, calibrates and doesn't train. Log-odds are counted in steps.
HELD_OUT, STEP, LOW, HIGH = 5, 0.05, -14.0, 14.0
#: Contents that occur more than once go with the tasks up to this number, beyond it by a join.
MAX_BROADCAST_ROWS = 2_000_000
#: The highest threshold: what only ever ends texts, and always without a mark, has even odds and isn't cut.
EVEN = -0.25
#: What the end of a text without a final mark counts: some of those are cut.
UNMARKED = 0.5
#: Weight of the shorter context, in observations.
BACK = 0.7
#: Characters of a context that are read; more than the longest order takes.
WINDOW = 160
#: Characters counted at once, and those whose contexts are worked out at once.
PART, STRETCH = 4_000_000, 300_000
#: Words of each training text that are cut to show how such a cut looks.
CUTS = 4
#: Weight of all cases beside those of a language and column.
SHRINK = 0.5
#: A language and column with fewer calibration cases uses the threshold of all.
LEAST_CASES = 200

#: What agents and imports put behind a text they cut.
CUT_WORDS = r"truncat|cut|clip|omit|trimm|shorten|abbreviat|limit reached|continu|remaining|more char|gekürzt|abgeschnitten|tronqu|coupé|recort|cortad|truncad|afgekapt|ingekort|обрез|сокращ"
#: What a transfer leaves that broke off, on a line of its own between marks.
BROKEN = r"connection|transfer|stream|lost|interrupt|abort|disconnect|time-?out|timed out|reset by|unexpected eof|end of (?:buffer|input|stream)|killed|incomplete|partial|verbindung|connexion|conexi|conex|verbinding|соединен"
CUT_SIGN = re.compile(
    rf"\s*(?:(?<=\n)[-=*#~_<>\[(!]{{2,}} ?[^\n]{{0,50}}(?:{CUT_WORDS}|{BROKEN})[^\n]{{0,50}}[-=*#~_<>\])!]{{2,}}|[\[(<{{]\s*(?:\.{{3}}|…)\s*[\])>}}]|[\[(<{{][^\[\](){{}}<>\n]{{0,60}}(?:{CUT_WORDS})[^\[\](){{}}<>\n]{{0,60}}[\])>}}]|…|\.{{3,}})\s*$", re.I
)
SIGN_LENGTH = 240
#: What the last character of a sign can be.
_SIGN_ENDS = frozenset("-=*#~_<>[])}!….")
CLOSERS = "\"'»”’)]}*_`"
#: Symbols: a name, path or code phrase; a closed code block; the start of a text; a word that isn't common.
NAME, BLOCK, BEGIN, RARE = "\x01", "\x02", "\x03", "\x04"
_FENCED = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[^\n]*\n.*?^[ \t]{0,3}\1[`~]*[^\w\n]*$", re.M | re.S)
_OPEN_FENCE = re.compile(r"^[ \t]{0,3}(?:`{3,}|~{3,})", re.M)
_KEY_BLOCK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]+-----")
_PHRASE = re.compile(r"`[^`\n]+`")
_NAMELIKE = re.compile(r"[\d_/\\@#=<>{}\[\]|$%^+~]|\w[.:(-]\w|[a-zа-яß-öø-ÿ][A-ZА-Я]|\(\)|--?\w")
_MARKED = re.compile(r"[.!?。！？]+[\"'»”’)\]}*_`]*(?:\s*[^\w\s.,;:!?…\"'`(){}\[\]<>/\\|=+*#&%$@~^-]+)?\s*$")
_MARKS = ".!?。！？"
_TAIL = re.compile(r"[\s.!?…\"'»”’)\]}*_`]+$")
_END = re.compile(r"[.!?…]+[\"'»”’)\]}*_`]*(?=\s|$)")


def _symbol(token: str) -> str:
    head = token.lstrip("([{<«„“\"'¿¡*")
    core = head.rstrip(".,;:!?…\"'»”’)]}*")
    if not core:
        return token
    front, back = token[: len(token) - len(head)], head[len(core) :]
    if core.isdigit():
        return f"{front}0{back}"
    return f"{front}{NAME}{back}" if _NAMELIKE.search(core) else token.lower()


class Reader(dict):
    """Tokens as the model reads them, each worked out once.

    Without a vocabulary names and numbers become one symbol each; with one, so does every word outside it, and the
    front part of a cut word.
    """

    LIMIT = 300_000

    def __init__(self, vocabulary: set[str] | None = None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> str:
        if token.isalpha() and token.islower():  # a word as it is, most tokens of prose
            out = token if self.vocabulary is None or token in self.vocabulary else RARE
        else:
            out = _symbol(token)
            if self.vocabulary is not None and NAME not in out:  # beside a name there are only marks
                out = coarse(out, self.vocabulary)
        if len(self) > self.LIMIT:
            self.clear()
        self[token] = out
        return out

    def read(self, text: str) -> str:
        lines = [" ".join([self[t] for t in line.split()]) for line in without_code(text).split("\n")]
        out = BEGIN + "\n".join([line for line in lines if line])
        # Where a language writes a space before its marks.
        for mark in "?!»…":
            if " " + mark in out:
                out = out.replace(" " + mark, mark)
        return out


def without_code(text: str) -> str:
    """Closed code blocks and code phrases as one symbol each."""
    if "```" in text or "~~~" in text:
        text = _FENCED.sub(BLOCK, text)
    return _PHRASE.sub(NAME, text) if "`" in text else text


_PLAIN = Reader()


def symbols(text: str) -> str:
    """The text as the model reads it: closed code blocks, code phrases, names and numbers are one symbol each."""
    return _PLAIN.read(text)


_LETTERS = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(rf"({_LETTERS.pattern})")
#: What may be cut inside in a text of symbols: words, those outside the vocabulary too, and names.
_WORDS = re.compile(rf"(?<![^\W\d_])[^\W\d_]+|{RARE}|{NAME}")


def frequent(counts: dict[str, int], n: int, share: float = 0.0005, least: int = 5) -> set[str]:
    """The words that occur often enough in n texts for contexts with them to be counted by the word."""
    limit = max(least, share * n)
    return {w for w, k in counts.items() if k >= limit}


def word_counts(texts: list[str]) -> Counter:
    """How often each word occurs in texts, names and numbers aside."""
    tokens: Counter = Counter()
    for text in texts:
        tokens.update(without_code(text).split())
    return token_words(tokens)


def token_words(tokens: dict[str, int]) -> Counter:
    """How often each word occurs in tokens that occur so often."""
    found: Counter = Counter()
    for token, n in tokens.items():
        if token.isalpha() and token.islower():
            found[token] += n
        elif NAME not in (symbol := _symbol(token)):
            for word in _LETTERS.findall(symbol):
                found[word] += n
    return found


def coarse(text: str, vocabulary: set[str]) -> str:
    """The text of symbols with every word outside the vocabulary as one symbol; so is the front part of a cut word."""
    parts = _SPLIT.split(text)
    parts[1::2] = [w if w in vocabulary else RARE for w in parts[1::2]]
    return "".join(parts)


def strip_sign(text: str) -> tuple[str, int]:
    """The text without the signs of a cut at its end, and the strongest of them, as a place in SHIFT."""
    sign, text = 0, text.rstrip()
    # A single full stop or question mark is no sign, and none can stand before it.
    if text[-1:] in (".", "?") and text[-2:-1] not in (".", "…"):
        return text, 0
    while text[-1:] in _SIGN_ENDS:
        # A sign is shorter than what is looked at.
        at = max(0, len(text) - SIGN_LENGTH)
        m = CUT_SIGN.search(text, at)
        if not m or not m[0]:
            return text, sign
        mark = m[0].strip()
        text, sign = text[: m.start()].rstrip(), max(sign, 3 if mark[0] in "[(<{-=*#~_!" else 2 if mark[0] == "…" else 1)
    return text, sign


def inside_block(text: str) -> bool:
    """True if text stops inside a fenced block or between the marker lines of a key."""
    m = None
    if "```" in text or "~~~" in text:
        rest = _FENCED.sub("", text)
        for m in _OPEN_FENCE.finditer(rest):
            pass
        if m and rest[m.end() :].strip():
            return True
    if "-----BEGIN " not in text:
        return False
    last = None
    for last in _KEY_BLOCK.finditer(text):
        pass
    return bool(last and last[1] == "BEGIN") or bool(re.search(r"-----BEGIN [^\n-]*-{0,4}$", text))


LIST_LINE = re.compile(r"^\s*(?:[-*+•→>]|\d{1,3}[.)])\s")


#: Last lines that are code by their form: an assignment, a link or image, the end of a key, a hash or other long string at the end.
CODE_LINE = re.compile(r"^\s*[\w.$\[\]\"'-]+\s*(?:=|:=|=>|: ?[\"'])\s*\S.*$|!?\[[^\]]*\]\([^()]*\)$|-----END [^\n]*-----$|(?:^|[\s=:\"'`/-])(?=[^\s]*\d)[A-Za-z0-9+/=_-]{24,}[`\"')\]}]*$")
#: Shift of the log-odds by what stands behind the text: nothing, dots, one character of three dots, a phrase in brackets.
SHIFT = (0.0, 0.0, -2.0, -6.0)


#: No limit cuts a text to so few words: shift of the log-odds for one line of at most SHORT words.
SHORT, SHORT_SHIFT = 6, 5.0
#: Contents of fewer characters are said again and again: each id's counts as one of its own.
SHORT_TEXT = 40


#: A length is a limit of its column if so large a share of all texts has it, and so many times as many as have each of
#: the NEAR lengths around it. A text of just that length that the model is asked about, as it has no final mark, ends there by chance
#: hardly ever: shift of its log-odds.
#: Limits of texts aren't shorter than LEAST_LIMIT.
LIMIT_SHARE, LIMIT_TIMES, NEAR, LEAST_LIMIT, LIMIT_SHIFT = 0.0003, 5, 8, 100, -30.0


def contents(texts: DataFrame) -> DataFrame:
    """tbl, h, size and n of each different content of texts (tbl, id, content), written; short ones differ by their id too."""
    return materialize(_hashed(texts).groupBy("tbl", "h", "size").agg(F.count("*").alias("n")), "contents")


def _hashed(texts: DataFrame) -> DataFrame:
    """tbl, content, its length, the hash that tells contents apart, and whether it is held out."""
    rows = texts.where("content IS NOT NULL").select("tbl", "id", "content", F.length("content").alias("size"), F.xxhash64("content").alias("plain"))
    return rows.select("tbl", "content", "size", F.when(F.col("size") < SHORT_TEXT, F.xxhash64("plain", "id")).otherwise(F.col("plain")).alias("h"), is_held_out(F.col("plain")).alias("held"))


def is_held_out(plain: Column) -> Column:
    """Whether a content calibrates and doesn't train, by its hash."""
    return F.pmod(plain, F.lit(HELD_OUT)) == HELD_OUT - 1


def limits(different: DataFrame) -> set[tuple[str, int]]:
    """(tbl, length) of the lengths at which different contents pile up, over all of contents(); at most 1 / LIMIT_SHARE a table."""
    n = different.groupBy("tbl", "size").agg(F.count("*").alias("n"))
    around = Window.partitionBy("tbl").orderBy("size").rangeBetween(-NEAR, NEAR)
    seen = n.withColumns({"others": F.sum("n").over(around) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("tbl"))})
    high = seen.where((F.col("size") >= LEAST_LIMIT) & (F.col("n") >= 10) & (F.col("n") >= LIMIT_SHARE * F.col("all")) & (F.col("n") >= LIMIT_TIMES * (F.col("others") / (2 * NEAR) + 1)))
    return {(x[0], x[1]) for x in high.select("tbl", "size").collect()}


def question(text: str) -> tuple[str, bool | None, int]:
    """(context, verdict, sign): verdict is False for what is complete, True for what is cut, None where the model decides."""
    bare, signed = strip_sign(text)
    if not bare:
        return "", False, signed
    line = bare[bare.rfind("\n") + 1 :]
    # Where any match begins, one begins at the last mark as well.
    last = max(map(bare.rfind, _MARKS))
    marked = last >= 0 and bool(_MARKED.match(bare, last))
    if inside_block(bare) and not (marked and len(prose_words(line)) >= 4):
        return "", True, signed
    if marked or bare.endswith("```") or (not signed and CODE_LINE.search(line)):
        return "", False, signed
    if LIST_LINE.match(line) and len(prose_words(line)) < 3:
        return "", False, signed
    if line.count("`") % 2 == 0 and line.endswith("`"):
        return "", False, signed
    if line.startswith(("    ", "\t")):
        return "", False, signed
    return _TAIL.sub("", symbols(bare)), None, signed


@dataclass
class EndModel:
    """For each order: sorted hashes of contexts, how often a text or sentence ended after them, how often they occurred."""

    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    prior: float
    thresholds: dict[tuple[str, str], float]
    vocabulary: set[str]
    limits: set[tuple[str, int]] = field(default_factory=set)

    def log_odds(self, contexts: list[str]) -> np.ndarray:
        """Natural log of end against continuation after each context of symbols."""
        contexts = [coarse(c[-WINDOW:], self.vocabulary) for c in contexts]
        p = np.full(len(contexts), self.prior)
        live = np.ones(len(contexts), dtype=bool)
        length = np.fromiter(map(len, contexts), np.int64, len(contexts))
        tails, rolling, done = _tails(contexts), np.zeros(len(contexts), np.uint64), 0
        for order, (keys, ends, total) in zip(ORDERS, self.tables, strict=True):
            live &= length >= order
            if not live.any() or not len(keys):
                break
            at = np.flatnonzero(live)
            rolling, done = rolling + _rolling(tails, done, order), order
            h = _bucket(_mix(rolling[at], order))
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            live[at[~hit]] = False
            at, k = at[hit], k[hit]
            p[at] = (ends[k] + BACK * p[at]) / (total[k] + BACK)
            # Where no text ever ended, longer contexts say no more.
            live[at[ends[k] == 0]] = False
        return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))


_BASE = np.uint64(0x100000001B3 * 2 + 1)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers of base below n, twice as many at a time."""
    out, done = np.ones(n, np.uint64), 1
    with np.errstate(over="ignore"):
        while done < n:
            np.multiply(out[: n - done][:done], base, out=out[done : 2 * done])
            base, done = base * base, 2 * done
    return out


def _mix(h: np.ndarray, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h


def _hash_tails(tails: list[str], order: int) -> np.ndarray:
    return _mix(_rolling(_tails(tails), 0, order), order)


def _tails(texts: list[str]) -> np.ndarray:
    """The characters before the end of each text, the last one first, as many as the longest order takes."""
    n = ORDERS[-1]
    return _codes("".join([t[-n:].rjust(n) for t in texts])).reshape(len(texts), n)[:, ::-1].astype(np.uint64)


def _rolling(tails: np.ndarray, done: int, order: int) -> np.ndarray:
    """What the characters from done to order add to the hash of each tail."""
    with np.errstate(over="ignore"):
        return ((tails[:, done:order] + np.uint64(1)) * _powers(_BASE, order)[done:]).sum(1, dtype=np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


#: Classes of characters behind the last word of a text: spaces, marks that end, other marks that are stripped.
_CLASS = np.zeros(0x110000, np.uint8)
_CLASS[[0, 10, 32]] = 1
_CLASS[[ord(c) for c in ".!?…"]] = 2
_CLASS[[ord(c) for c in CLOSERS]] = 3
_SOFT = np.asarray([ord(c) for c in ",;:"], np.uint32)


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of the texts in codes, each with a 0 behind it, end, and in halves whether text or sentence ends there."""
    kind = _CLASS[codes]
    word, space = kind[:-1] == 0, kind[1:] == 1
    # Marks between a word and a space: the place of each run of them, which ends where no mark is next.
    run = np.flatnonzero(word & (kind[1:] > 1))
    stop = np.flatnonzero((kind[:-1] > 1) & (kind[1:] < 2)) + 1
    stop = stop[np.searchsorted(stop, run, side="right")] if len(stop) else run
    closed = kind[stop] == 1
    run, stop = run[closed], stop[closed]
    ends = word & space
    ends[run] = True
    here = np.flatnonzero(ends)
    after, marked, far = here + 1, np.zeros(len(here), bool), np.searchsorted(here, run)
    after[far] = stop
    marks = np.concatenate(([0], np.cumsum(kind == 2, dtype=np.int32)))
    marked[far] = marks[stop] > marks[run]
    last = codes[after]
    # What stands before a comma goes on.
    soft = here[np.isin(codes[here], _SOFT)] - 1
    soft = soft[kind[np.maximum(soft, 0)] == 0]
    ended = np.where(marked | (last == 10), 2, np.where(last == 0, int(2 * UNMARKED), 0)).astype(np.int64)
    return np.concatenate((here, soft)), np.concatenate((ended, np.zeros(len(soft), np.int64)))


def _fronts(text: str, seed: int, vocabulary: set[str]) -> list[str]:
    """Contexts that end inside CUTS words of a text as the model reads it, each the next after some place."""
    out, find, size = [], _WORDS.search, len(text)
    for _ in range(CUTS):
        seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
        m = find(text, (seed >> 8) % size)
        if not m:
            continue
        a, b = m.span()
        if text[a] == NAME:  # its front part is a name still, or looks like a word
            front = NAME if seed >> 20 & 1 else RARE
        elif text[a] == RARE or b - a > 1:
            front = text[a : a + 1 + (seed >> 4) % max(1, b - a - 1)]
            front = front if front in vocabulary else RARE
        else:
            continue
        out.append(text[max(0, a - ORDERS[-1]) : a] + front)
    return out


class EndCounts:
    """Counters of contexts: how often they occurred, and in halves how often a text or sentence ended after them."""

    def __init__(self, vocabulary: set[str]):
        self.reader, self.vocabulary = Reader(vocabulary), vocabulary
        self.total = np.zeros((len(ORDERS), 1 << BUCKET_BITS))
        self.ends = np.zeros((len(ORDERS), 1 << BUCKET_BITS))
        self.up = self.down = np.zeros(0, np.uint64)  # powers for the longest block so far
        self.held: list[str] = []
        self.weights: list[float] = []
        self.held_size = 0

    def add(self, texts: list[str], weights: list[float] | None = None) -> None:
        """weights: how much each text counts, so that n copies of one text count once."""
        for text, weight in zip(texts, weights if weights is not None else [1.0] * len(texts), strict=True):
            bare = _teaching(text)
            if bare is None:
                continue
            read = self.reader.read(bare)
            self.held.append(read)
            self.weights.append(weight)
            self.held_size += len(read)
            if self.held_size > PART:
                self.count()

    def count(self) -> None:
        """Count what is held."""
        read, weight, self.held, self.weights, self.held_size = self.held, self.weights, [], [], 0
        if not read:
            return
        whole, blocks, begin, size = all(w == 1 for w in weight), [], 0, 0
        for i, text in enumerate(read, 1):
            size += len(text)
            if size >= STRETCH or i == len(read):
                blocks.append(self._contexts(read[begin:i], None if whole else np.asarray(weight[begin:i])))
                begin, size = i, 0
        for i in range(len(ORDERS)):
            bucket, weigh, of_ends, ended = zip(*(block[i] for block in blocks), strict=True)
            self.total[i] += np.bincount(np.concatenate(bucket), weights=None if whole else np.concatenate(weigh), minlength=1 << BUCKET_BITS)
            self.ends[i] += np.bincount(np.concatenate(of_ends), weights=np.concatenate(ended), minlength=1 << BUCKET_BITS)

    def _contexts(self, read: list[str], weight: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
        """By order: the counters of the contexts of texts, how much each counts, those where something ends, and how much."""
        fronts, of = [], []
        for i, t in enumerate(read):
            found = _fronts(t, zlib.crc32(t.encode("utf-8", "surrogatepass")), self.vocabulary)
            fronts += found
            of += [i] * len(found)
        every = read + fronts
        codes = _codes("\0".join(every) + "\0")
        size = np.fromiter((len(t) + 1 for t in every), np.int64, len(every))
        start = np.cumsum(size) - size
        edge = int(size[: len(read)].sum())
        at, ended = _places(codes[:edge])
        inside = start[len(read) :] + size[len(read) :] - 2
        at, ended = np.concatenate((at, inside)), np.concatenate((ended, np.zeros(len(inside), np.int64)))
        text = np.repeat(np.arange(len(size), dtype=np.int32), size)[at]
        place, weigh = at - start[text] + 1, None if weight is None else np.concatenate((weight, weight[np.asarray(of, np.int64)]))[text]
        some = np.flatnonzero(ended)
        ended = ended[some] if weigh is None else ended[some] * weigh[some]
        if len(self.up) < len(codes):
            self.up, self.down = _powers(_BASE, len(codes)), _powers(_INVERSE, len(codes))
        out = []
        with np.errstate(over="ignore"):
            # What the characters before each place add up to, the first by the highest power of the inverse: the hash of a context
            # of any length is a difference of two such sums, times a power.
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.add(codes, np.uint64(1), out=sums[1:])
            sums[1:] *= self.down[: len(codes)]
            np.cumsum(sums[1:], out=sums[1:])
            upper, power, rolling = sums[at + 1], self.up[at], np.empty(len(at), np.uint64)
            for order in ORDERS:
                np.subtract(upper, np.take(sums, at + (1 - order), mode="clip", out=rolling), out=rolling)
                rolling *= power
                bucket, long = _bucket(_mix(rolling, order)).astype(np.int32), place >= order
                also = long[some]
                out.append((bucket[long], None if weigh is None else weigh[long], bucket[some[also]], ended[also]))
        return out

    def parts(self) -> Iterator[tuple[int, int, bytes]]:
        """(order, chunk, body) of what was counted."""
        self.count()
        step = (1 << BUCKET_BITS) // CHUNKS
        for i in range(len(ORDERS)):
            for c in range(CHUNKS):
                total = self.total[i, c * step : (c + 1) * step]
                if total.any():
                    yield i, c, _pack(total, self.ends[i, c * step : (c + 1) * step])

    def model(self) -> EndModel:
        step = (1 << BUCKET_BITS) // CHUNKS
        parts = [(i, c, *map(np.rint, _unpack(body, step))) for i, c, body in self.parts()]  # counts what is held as well
        return _model(parts, self.vocabulary, {i: _floor(_masses(np.rint(t))) for i, t in enumerate(self.total)}, _prior(int(np.rint(self.total[0]).sum()), int(np.rint(self.ends[0]).sum())))


def _pack(total: np.ndarray, ends: np.ndarray) -> bytes:
    """Counters that aren't 0, and of them those with ends; the shuffle compresses what it moves."""
    at = np.flatnonzero(total)
    also = np.flatnonzero(ends[at])
    parts = (np.uint32([len(at)]), at.astype(np.uint32), total[at].astype(np.float32), also.astype(np.uint32), ends[at][also].astype(np.float32))
    return b"".join(x.tobytes() for x in parts)


def _unpack(body: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    at = np.frombuffer(body, np.uint32, n, 4)
    m = (len(body) - 4 - 8 * n) // 8
    total, ends = np.zeros(size), np.zeros(size)
    total[at] = np.frombuffer(body, np.float32, n, 4 + 4 * n)
    ends[at[np.frombuffer(body, np.uint32, m, 4 + 8 * n)]] = np.frombuffer(body, np.float32, m, 4 + 8 * n + 4 * m)
    return total, ends


def _masses(total: np.ndarray) -> np.ndarray:
    """Occurrences in counters of each size, by powers of two."""
    return np.bincount(np.frexp(total)[1], weights=total, minlength=64).astype(np.int64)


def _floor(masses: np.ndarray) -> int:
    """Occurrences from which a counter of an order counts, by the order's masses."""
    for top in range(63, 0, -1):
        noise = -(-NOISE * int(masses[: top + 1].sum()) // (1 << BUCKET_BITS))
        if noise >= 1 << (top - 1):
            return max(LEAST_SEEN, noise)
    return LEAST_SEEN


def _model(parts: list[tuple[int, int, np.ndarray, np.ndarray]], vocabulary: set[str], floors: dict[int, int], prior: float) -> EndModel:
    """The model of the counters in parts (order, chunk, total, ends)."""
    step, tables = (1 << BUCKET_BITS) // CHUNKS, []
    for i in range(len(ORDERS)):
        keys, ends, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, np.float32)]
        for _, c, total, end in sorted((x for x in parts if x[0] == i), key=lambda x: x[1]):
            at = np.flatnonzero(total >= floors[i])
            keys.append(at + c * step)
            ends.append((end[at] / 2).astype(np.float32))
            totals.append(total[at].astype(np.float32))
        tables.append((np.concatenate(keys), np.concatenate(ends), np.concatenate(totals)))
    return EndModel(tables, prior, {}, vocabulary)


def _prior(seen: int, ended: int) -> float:
    return min(max(ended / 2 / seen, 1e-4), 0.5) if seen else 0.5


def fit(texts: list[str]) -> EndModel:
    """The model of texts in memory."""
    counts = EndCounts(frequent(word_counts(texts), len(texts)))
    counts.add(texts)
    return counts.model()


def count_contexts(texts: DataFrame, vocabulary: set[str]) -> EndModel:
    """The model of all texts (content, weight): every task counts into arrays of fixed size, which are added up in parts."""
    blob = texts.sparkSession.sparkContext.broadcast(vocabulary)
    step = (1 << BUCKET_BITS) // CHUNKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = EndCounts(blob.value)
        for batch in batches:
            counts.add(batch["content"].tolist(), batch["weight"].tolist())
        for part in counts.parts():
            yield pd.DataFrame([part], columns=["order", "chunk", "body"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total, ends = np.zeros(step), np.zeros(step)
        for body in group["body"]:
            t, e = _unpack(body, step)
            total += t
            ends += e
        total, ends = np.rint(total), np.rint(ends)  # all copies of a text together are whole
        return pd.DataFrame([(*key, _masses(total), int(ends.sum()), _pack(total, ends))], columns=["order", "chunk", "masses", "ended", "body"])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, c, body in zip(batch["order"], batch["chunk"], batch["body"], strict=True):
                total, ends = _unpack(body, step)
                often = total >= floors[i]
                out.append((i, c, _pack(np.where(often, total, 0), ends)))
            yield pd.DataFrame(out, columns=["order", "chunk", "body"])

    parts = texts.select("content", "weight").mapInPandas(count, "order int, chunk int, body binary")
    summed = materialize(parts.groupBy("order", "chunk").applyInPandas(add, "order int, chunk int, masses array<long>, ended long, body binary"), "contexts")
    masses, ended = {i: np.zeros(64, np.int64) for i in range(len(ORDERS))}, 0
    for i, m, e in summed.select("order", "masses", "ended").collect():  # len(ORDERS) * CHUNKS rows
        masses[i] += np.asarray(m)
        ended += e if i == 0 else 0
    floors = {i: _floor(m) for i, m in masses.items()}
    rows = summed.select("order", "chunk", "body").mapInPandas(keep, "order int, chunk int, body binary").collect()
    return _model([(i, c, *_unpack(body, step)) for i, c, body in rows], vocabulary, floors, _prior(int(masses[0].sum()), ended))


def _cases(text: str) -> tuple[str, str] | None:
    """A complete case of a text, at the end of one of its sentences without the mark, and a cut one, at a place inside."""
    s = symbols(text)
    stops = [m.start() for m in _END.finditer(s) if m.start() > 10]
    if not stops or len(s) < 20:
        return None
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    stop, place = stops[(seed >> 8) % len(stops)], 5 + (seed * 1103515245 + 12345 >> 8) % (len(s) - 5)
    while place < len(s) and (s[place - 1] in " \n.!?…" or _END.match(s, place) or s[place] == "\n"):
        place += 1
    return None if place >= len(s) else (_TAIL.sub("", s[:stop]), _TAIL.sub("", s[:place]))


def _steps(values: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(values, LOW, HIGH) - LOW) / STEP).astype(np.int64)


def case_scores(texts: list[str], columns: list[str], langs: list[str], model: EndModel) -> Counter:
    """How many cases of (language, column, is cut) have log-odds in each step."""
    chosen = [(lang, column, case) for text, column, lang in zip(texts, columns, langs, strict=True) if (case := _cases(text))]
    found: Counter = Counter()
    if chosen:
        for cut in (False, True):
            steps = _steps(model.log_odds([c[cut] for _, _, c in chosen]))
            found.update((lang, column, cut, int(k)) for (lang, column, _), k in zip(chosen, steps, strict=True))
    return found


def thresholds(found: dict[tuple[str, str, bool, int], int]) -> dict[tuple[str, str], float]:
    """The threshold of each language and column with enough cases, and of all under ("", "").

    It makes the fewest errors among the pair's cases and, weighted less, among all; between equals it is the one
    nearest to even odds, and never above EVEN.
    """
    n = int((HIGH - LOW) / STEP) + 1
    pairs: dict[tuple[str, str], np.ndarray] = {}
    every = np.zeros((2, n))
    for (lang, column, cut, k), count in found.items():
        pairs.setdefault((lang, column), np.zeros((2, n)))[int(cut), k] += count
        every[int(cut), k] += count
    edges = LOW + STEP * np.arange(n + 1)

    def errors(h: np.ndarray) -> np.ndarray:
        # Below the threshold counts as cut: errors are the complete cases below and the cut ones from it on.
        return np.concatenate(([0], np.cumsum(h[0]))) + h[1].sum() - np.concatenate(([0], np.cumsum(h[1])))

    def best(e: np.ndarray) -> float:
        e = np.where(edges <= EVEN + 1e-9, e, np.inf)
        least = edges[np.flatnonzero(e <= e.min() + 1e-9)]
        return float(least[np.abs(least).argmin()])

    if not every.any():
        return {("", ""): 0.0}
    out = {("", ""): best(errors(every))}
    for pair, h in pairs.items():
        if h[1].sum() >= LEAST_CASES:
            out[pair] = best(errors(h) + SHRINK * h.sum() / every.sum() * errors(every))
    return out


def calibrate(held: DataFrame, model: EndModel, languages: CharModel) -> dict[tuple[str, str], float]:
    """Thresholds by language and column from all texts (tbl, content) left out of training."""
    blob = held.sparkSession.sparkContext.broadcast(pickle.dumps((model, languages)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, langs = pickle.loads(blob.value)
        scores, found = TextScores(langs), Counter()
        for batch in batches:
            found.update(held_scores(batch["content"].tolist(), batch["tbl"].tolist(), ends, scores))
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "tbl", "cut", "step", "n"])

    return summed_thresholds(held.select("tbl", "content").mapInPandas(run, "lang string, tbl string, cut boolean, step int, n long"))


def held_scores(texts: list[str], columns: list[str], model: EndModel, scores: TextScores, langs: list[str] | None = None) -> Counter:
    """case_scores of texts left out of training. langs are the whole texts' languages where they are known already."""
    bare = [_teaching(t) for t in texts]
    at = [i for i, t in enumerate(bare) if t]
    # A text without a sign at its end is the same prose.
    new = [i for i in at if langs is None or len(bare[i]) != len(texts[i].rstrip())]
    lang = dict(zip(new, text_language([bare[i] for i in new], scores), strict=True))
    return case_scores([bare[i] for i in at], [columns[i] for i in at], [lang[i] if i in lang else langs[i] for i in at], model)


def summed_thresholds(cases: DataFrame) -> dict[tuple[str, str], float]:
    """thresholds() of what tasks counted (lang, tbl, cut, step, n)."""
    return thresholds({(r[0], r[1], r[2], r[3]): r[4] for r in cases.groupBy("lang", "tbl", "cut", "step").agg(F.sum("n")).collect()})


def text_language(texts: list[str], scores: TextScores) -> list[str]:
    """The language of the prose of each text, "" where there is none."""
    which, _ = language.best(scores.model, *scores.sums(*scores.numbers(texts), len(texts)))
    return [scores.model.languages[j] if j >= 0 else "" for j in which]


def train(texts: DataFrame, samples: DataFrame, rows: int | None = None, calibrated: bool = True) -> tuple[EndModel, CharModel]:
    """The end model with its thresholds and limits, and the language models, from texts (tbl, id, content).

    Words, contexts, thresholds and limits are counted over all texts; the language models come from samples and from
    the words of all texts. Equal contents count once, those of a few words once an id, so that copies don't vouch for
    their own ends. Texts with a sign of a cut other than three dots, or that stop inside a block,
    don't teach where texts end. Without calibrated the thresholds are left to the caller, who reads the texts anyway.
    """
    n = texts.count() if rows is None else rows
    labelled = language._bounded(samples, ["lang", "text"], language.MAX_SAMPLES)
    languages, counted = language.adapt(language.train_calibrated(labelled), labelled, texts.select("content"), word_counts, max(5, 0.0005 * n), token_words)
    # At most (words a text) / share of them, whatever the number of texts.
    vocabulary = frequent(counted, n)
    hashed, different = _hashed(texts), contents(texts)
    copies = materialize(different.where("n > 1").select("tbl", "h", "n"), "copies")
    few = copies.count() <= MAX_BROADCAST_ROWS
    weighed = hashed.where("NOT held").join(F.broadcast(copies) if few else copies, ["tbl", "h"], "left")
    model = count_contexts(weighed.select("content", (1.0 / F.coalesce("n", F.lit(1))).alias("weight")), vocabulary)
    if calibrated:
        model.thresholds = calibrate(hashed.where("held"), model, languages)
    model.limits = limits(different)
    return model, languages


def _teaching(text: str) -> str | None:
    bare, signed = strip_sign(text)
    return bare if signed <= 1 and bare and not inside_block(bare) else None


def judge(texts: list[str], columns: list[str], model: EndModel, scores: TextScores, langs: list[str] | None = None) -> tuple[list[bool], list[float | None]]:
    """Whether each text is cut, and the log-odds of an end where the model was asked. Null and blank are no cases.

    langs are the texts' languages where they are known already.
    """
    cut, odds = shifted_odds(texts, columns, model)
    open_ = [i for i, x in enumerate(odds) if x is not None]
    lang = text_language([texts[i] for i in open_], scores) if langs is None else [langs[i] for i in open_]
    for i, g in zip(open_, lang, strict=True):
        cut[i] = odds[i] < model.thresholds.get((g, columns[i]), model.thresholds[("", "")])
    return cut, odds


def shifted_odds(texts: list[str], columns: list[str], model: EndModel) -> tuple[list[bool | None], list[float | None]]:
    """Whether each text is cut where that is known without the model, and what is compared with the threshold where it isn't."""
    asked = [question(t or "") for t in texts]
    cut = [v for _, v, _ in asked]
    odds: list[float | None] = [None] * len(texts)
    open_ = [i for i, v in enumerate(cut) if v is None]
    if open_:
        for i, x in zip(open_, model.log_odds([asked[i][0] for i in open_]), strict=True):
            x += (LIMIT_SHIFT if (columns[i], len(texts[i])) in model.limits else 0) + SHIFT[asked[i][2]] + (SHORT_SHIFT if asked[i][2] <= 1 and len(asked[i][0].split()) <= SHORT and "\n" not in asked[i][0] else 0)
            odds[i] = float(x)
    return cut, odds


def find_cut(texts: DataFrame, samples: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """tbl, id, the columns named in extra, cut and log_odds for each row of texts (tbl, id, content).

    Null, blank and empty contents are never cut. The models go with the tasks; their size doesn't grow with the texts.
    """
    usable = texts.where(~is_blank(F.col("content")))
    blob = texts.sparkSession.sparkContext.broadcast(pickle.dumps(train(usable, samples, rows=texts.count())))
    keep = ["tbl", "id", *extra]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, languages = pickle.loads(blob.value)
        scores = TextScores(languages)
        for batch in batches:
            if not len(batch):
                continue
            cut, odds = judge(batch["content"].tolist(), batch["tbl"].tolist(), model, scores)
            yield batch[keep].assign(cut=cut, log_odds=pd.Series(odds, index=batch.index, dtype="float64"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema)
    return usable.select(*keep, "content").mapInPandas(run, f"{kinds}, cut boolean, log_odds double")
