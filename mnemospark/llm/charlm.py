"""Interpolated Kneser-Ney character models of several languages in sorted hash arrays.

A text is scored word by word: each word is padded to the model's order, so a word's score doesn't depend on its
neighbours and is computed once a worker. All languages share the arrays: a key is the hash of an n-gram, its row
holds one discounted probability a language, and a second array holds the weights of the shorter context.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

from mnemospark.llm.prose import SentenceWords, WordNumbers, formatted, prose_tokens, prose_words, sentences

START, END = 2, 3
#: Everyday words of each language. A few dozen samples lack most of what a short question is made of, and
#: what a model has never seen in its own language may look like a neighbouring one.
EVERYDAY = {
    "en": "how what why when where which who does did is are can could should would the this that it with from have not you we they but and",
    "de": "wie was warum wann wo welche wer ist sind kann könnte soll würde der die das es mit von habe nicht du ich wir sie aber und noch mache",
    "fr": "comment quoi pourquoi quand où quel qui est sont peut pourrait doit le la les ce avec après dans pas vous je nous ils mais et fais",
    "es": "cómo qué por cuándo dónde cuál quién es son puede podría debe el la los esto con después tengo no usted yo ellos pero y hago hay",
    "pt": "como que porquê quando onde qual quem é são pode poderia deve o os isto com depois tenho não você eu nós eles mas e faço há",
    "nl": "hoe wat waarom wanneer waar welke wie is zijn kan zou moet de het dit met van heb niet je ik we zij maar en nog doe",
    "ru": "как что почему когда где какой кто есть это может должен после от имею не вы я мы они но и ещё делаю",
}
#: How often each of them counts as seen.
EVERYDAY_COUNT = 4
#: Words whose n-grams are worked out at once.
WORDS_AT_ONCE = 50_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of padded words in one array, the word of each, and where a character is predicted."""
    lengths = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
    size = lengths + order  # order - 1 starts, the word, one end
    codes = np.full(size.sum(), START, dtype=np.uint64)
    ends = np.cumsum(size)
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = ends - lengths - 1
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(text))
    codes[at] = text
    codes[ends - 1] = END
    of = np.repeat(np.arange(len(words)), size)
    predicted = np.ones(len(codes), dtype=bool)
    starts = ends - size
    for k in range(order - 1):
        predicted[starts + k] = False
    return codes, of, predicted


def _keys(codes: np.ndarray, n: int, shift: int = 0) -> np.ndarray:
    """Hash of the n characters that end at each position, or shift positions before it."""
    h = np.full(len(codes), n * 1_000_003 + 17, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1 + shift, shift - 1, -1):
            part = codes if k == 0 else np.concatenate((np.zeros(k, np.uint64), codes[:-k]))
            h = (h ^ part) * _MULT
            h ^= h >> np.uint64(29)
    return h


def _gram_sets(words: Counter, order: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n the different n-grams: sorted keys, their contexts, the n-grams one shorter, how often they occur.

    Words are taken in parts, so that memory is held for different n-grams and not for every word.
    """
    held: dict[int, tuple[np.ndarray, ...]] = {}
    items = iter(words.items())
    while (part := list(islice(items, WORDS_AT_ONCE))) or not held:
        codes, of, predicted = _codes([w for w, _ in part], order)
        weight = np.fromiter((n for _, n in part), np.float64, len(part))[of][predicted]
        shorter = _keys(codes, 0)[predicted]
        for n in range(1, order + 1):
            gram = _keys(codes, n)[predicted]
            new = (gram, _keys(codes, n - 1, 1)[predicted], shorter, weight)
            shorter = gram
            merged = tuple(np.concatenate(x) for x in zip(held[n], new, strict=True)) if n in held else new
            keys, first, inverse = np.unique(merged[0], return_index=True, return_inverse=True)
            held[n] = (keys, merged[1][first], merged[2][first], np.bincount(inverse, weights=merged[3], minlength=len(keys)))
    return held


@dataclass
class CharModel:
    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # by n: sorted keys, probability by language
    histories: list[tuple[np.ndarray, np.ndarray]]  # by n: sorted keys of contexts, weight of the shorter model
    ceiling: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by language: cross-entropy beyond which it is rejected

    @classmethod
    def train(cls, words: dict[str, Counter], order: int = 5, alphabet: int = 400) -> CharModel:
        """words: for each language, how often each word occurs."""
        languages = sorted(words)
        per: list[list[tuple]] = [[] for _ in range(order)]
        for lang in languages:
            sets = _gram_sets(words[lang], order)
            for n in range(order, 0, -1):
                keys, ctx, _, c = sets[n]
                if n < order:  # how many different characters precede it
                    c = np.unique(sets[n + 1][2], return_counts=True)[1].astype(np.float64)
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
                hist, inv = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(inv, weights=c), np.bincount(inv)
                per[n - 1].append((keys, np.maximum(c - d, 0) / total[inv], hist, d * kinds / total))
        grams, histories = [], []
        for n in range(order):
            keys = np.unique(np.concatenate([p[0] for p in per[n]]))
            prob = np.zeros((len(keys), len(languages)), dtype=np.float32)
            hist = np.unique(np.concatenate([p[2] for p in per[n]]))
            back = np.ones((len(hist), len(languages)), dtype=np.float32)
            for j, (k, p, h, b) in enumerate(per[n]):
                prob[np.searchsorted(keys, k), j] = p
                back[np.searchsorted(hist, h), j] = b
            grams.append((keys, prob))
            histories.append((hist, back))
        model = cls(languages, order, grams, histories)
        model.alphabet = alphabet
        return model

    alphabet: int = 400

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability, by language; the end of the word is one more character."""
        if not words:
            return np.zeros((0, len(self.languages)))
        codes, of, predicted = _codes(words, self.order)
        p = np.full((int(predicted.sum()), len(self.languages)), 1.0 / self.alphabet)
        for n in range(1, self.order + 1):
            gram, context = _keys(codes, n)[predicted], _keys(codes, n - 1, 1)[predicted]
            keys, prob = self.grams[n - 1]
            hist, back = self.histories[n - 1]
            i = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            j = np.minimum(np.searchsorted(hist, context), len(hist) - 1)
            a = np.where((keys[i] == gram)[:, None], prob[i], 0)
            b = np.where((hist[j] == context)[:, None], back[j], 1)
            p = a + b * p
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, of[predicted], np.log(p))
        return out


def without_accents(word: str) -> str:
    """A word of Latin letters without its accents; others as they are."""
    if word.isascii() or word[:1] >= "\u0370":
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def count_words(texts: list[str]) -> Counter:
    """The prose words of texts, and each word with accents once more without them, as many writers leave them out."""
    found: Counter = Counter()
    for text in texts:
        for _, _, sentence, _ in sentences(text):
            found.update(prose_words(sentence))
    for word, n in list(found.items()):
        bare = without_accents(word)
        if bare != word:
            found[bare] += max(1, n // 4)
    return found


def language_words(lang: str, texts: list[str]) -> Counter:
    """The words of texts of a language, with its everyday words if they are known."""
    found = count_words(texts)
    for word in EVERYDAY.get(lang, "").split():
        for form in {word, without_accents(word)}:
            found[form] += EVERYDAY_COUNT if form == word else 1
    return found


def cross_entropy(model: CharModel, words: list[str]) -> np.ndarray:
    """Nats a character of the words together, by language."""
    return -model.score(words).sum(0) / max(1, sum(len(w) + 1 for w in words))


def train_calibrated(samples: list[tuple[str, str]], order: int = 5, folds: int = 4, slack: float = 1.5) -> CharModel:
    """Train on (language, text) samples, with a ceiling of cross-entropy for each language.

    The ceiling is the greatest cross-entropy of a sample that was left out of training, plus slack nats a character:
    what is further from every language than any of the samples belongs to none.
    """
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        if lang and text:
            by.setdefault(lang, []).append(text)
    model = CharModel.train({lang: language_words(lang, texts) for lang, texts in by.items()}, order)
    worst = np.zeros(len(model.languages))
    for fold in range(folds):
        kept = {lang: [t for i, t in enumerate(texts) if i % folds != fold] for lang, texts in by.items()}
        if not all(kept.values()):
            continue
        part = CharModel.train({lang: language_words(lang, texts) for lang, texts in kept.items()}, order)
        for j, lang in enumerate(part.languages):
            for i, text in enumerate(by[lang]):
                words = [w for _, _, s, _ in sentences(text) for w in prose_words(s)]
                if i % folds == fold and words:
                    worst[j] = max(worst[j], cross_entropy(part, words)[j])
    model.ceiling = np.where(worst > 0, worst + slack, np.log(model.alphabet))
    return model


class LanguageVotes:
    """How often each word occurs in the texts of each language, as a model reads them.

    A text counts for its best language if that leads by text_lead nats. The first round takes all its sentences: a
    phrase that the samples lack may look foreign, but most texts that hold it are of its language. Later rounds leave
    out the sentences that another language leads by sentence_lead nats.
    """

    #: Different words, and tokens of texts, that are held at once.
    LIMIT, TOKENS = 200_000, 500_000

    def __init__(self, model: CharModel, first: bool, text_lead: float = 20.0, sentence_lead: float = 15.0):
        self.model, self.first, self.text_lead, self.sentence_lead = model, first, text_lead, sentence_lead
        self.sentences = 0
        self.packed: list[tuple[str, bytes]] = []
        #: Of the texts that came last the formatted ones; what the tokens of all others give, if asked for.
        self.formed: list[str] = []
        self.token_words: Callable[[dict[str, int]], Counter] | None = None
        self.other: Counter = Counter()
        self._start()

    def _start(self) -> None:
        self.read, self.rows = SentenceWords(), np.zeros((1, len(self.model.languages)))
        self.counts, self.seen = np.zeros((len(self.model.languages), 1), np.int64), np.zeros(1, np.int64)

    def add(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """Take texts; what is given back are counts that would take too much room. packed gets what was read of them."""
        ids: list[int] = []
        edges, forms = [], []
        self.formed = []
        for text in texts:
            form = formatted(text)
            ids += self.read.ids(text, form)
            edges.append(len(ids))
            forms.append(form)
            if form:
                self.formed.append(text)
            if len(ids) >= self.TOKENS:
                self._count(ids, edges, forms)
                ids, edges, forms = [], [], []
                if len(self.read) > self.LIMIT:
                    yield from self.take()
        if edges:
            self._count(ids, edges, forms)
        if len(self.read) > self.LIMIT:
            yield from self.take()

    def add_packed(self, words: str, body: bytes) -> Iterator[tuple[str, str, int]]:
        """The same for what add packed, without reading the texts again."""
        n, m = np.frombuffer(body, np.uint32, 2)
        sizes = np.frombuffer(body, np.uint32, n, 8)
        of_texts = np.frombuffer(body, np.uint32, m, 8 + 4 * n)
        own = words.split(" ")
        word = np.frombuffer(body, _width(len(own)), offset=8 + 4 * (n + m))
        self._vote(np.array([self.read.of_word(w) for w in own])[word], np.repeat(np.arange(n), sizes), np.repeat(np.arange(m), of_texts), int(m))
        if len(self.read.words) > self.LIMIT:
            yield from self.take()

    def take(self) -> Iterator[tuple[str, str, int]]:
        """(language, word, n) of what was counted, which starts anew."""
        words, counts = self.read.words, self.counts
        if self.token_words:
            self.other.update(self.token_words({t: n for t, n in zip(self.read, self.seen[1:].tolist(), strict=False) if n}))
        self._start()
        for j, i in zip(*np.nonzero(counts), strict=True):
            yield self.model.languages[j], words[i], int(counts[j, i])

    def _count(self, ids: list[int], edges: list[int], forms: list[bool]) -> None:
        every = np.array(ids, np.int64)
        if self.token_words:
            seen = np.bincount(every[np.repeat(~np.array(forms), np.diff(edges, prepend=0))], minlength=len(self.read.code))
            seen[: len(self.seen)] += self.seen
            self.seen = seen
        token = np.array(self.read.code, np.int64)[every]
        ends = (token & 2) > 0
        for i in np.flatnonzero((token & 3) == 2):  # one mark only: it ends no sentence that it begins
            ends[i] = i > 0 and not ends[i - 1]
        at = np.flatnonzero(token >> 2)
        if not len(at):
            return
        word = token[at] >> 2
        sentence = (np.cumsum(ends) - ends)[at]
        begins = np.concatenate(([True], sentence[1:] != sentence[:-1]))
        sentence = np.cumsum(begins) - 1
        owner = np.searchsorted(np.asarray(edges), at[begins], side="right")
        used = np.bincount(word, minlength=len(self.read.words)) > 0
        own = np.flatnonzero(used)
        local = (np.cumsum(used) - 1).astype(_width(len(own)))[word]
        body = (np.uint32([len(owner), len(edges)]), np.bincount(sentence).astype(np.uint32), np.bincount(owner, minlength=len(edges)).astype(np.uint32), local)
        self.packed.append((" ".join([self.read.words[i] for i in own]), b"".join(x.tobytes() for x in body)))
        self._vote(word, sentence, owner, len(edges))

    def _vote(self, word: np.ndarray, sentence: np.ndarray, owner: np.ndarray, texts: int) -> None:
        """Count words of sentences (each word's) of texts (each sentence's)."""
        new, wide = self.read.words[len(self.rows) :], len(self.read.words)
        self.rows = np.concatenate([self.rows, *(self.model.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        n = len(owner)
        logp = np.stack([np.bincount(sentence, weights=self.rows[word, j], minlength=n) for j in range(self.rows.shape[1])], 1)
        whole = np.stack([np.bincount(owner, weights=logp[:, j], minlength=texts) for j in range(logp.shape[1])], 1)
        main = whole.argmax(1)
        ranked = np.sort(whole, 1)
        taken = ranked[:, -1] - ranked[:, -2] >= self.text_lead if whole.shape[1] > 1 else np.ones(len(whole), bool)
        lang, taken = main[owner], taken[owner]
        if not self.first:
            taken = taken & (logp.max(1) - logp[np.arange(n), lang] < self.sentence_lead)
        of = taken[sentence]
        found = np.bincount(lang[sentence[of]] * wide + word[of], minlength=len(self.counts) * wide).reshape(-1, wide)
        found[:, : self.counts.shape[1]] += self.counts
        self.counts = found
        self.sentences += n


def _width(words: int) -> type:
    """The narrowest numbers for so many words."""
    return np.uint8 if words <= 1 << 8 else np.uint16 if words <= 1 << 16 else np.uint32


def retrain(model: CharModel, samples: list[tuple[str, str]], votes: dict[str, dict[str, int]]) -> CharModel:
    """Train again with samples and the words that LanguageVotes found. The ceilings of the model stay."""
    words_of = {lang: language_words(lang, [t for x, t in samples if x == lang and t]) for lang in model.languages}
    for lang, counts in words_of.items():
        counts.update(votes.get(lang, {}))
        for word, n in list(counts.items()):
            bare = without_accents(word)
            if bare != word:
                counts[bare] += max(1, n // 4)
    out = CharModel.train(words_of, model.order, model.alphabet)
    out.ceiling = model.ceiling
    return out


class WordScores:
    """Scores of words, each computed once; the cache starts anew when it holds LIMIT words, to bound memory."""

    LIMIT = 400_000

    def __init__(self, model: CharModel):
        self.model = model
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages)))
        self.chars = np.zeros(1024)

    def ids(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in self.rows; valid until the next call."""
        if len(self.index) > self.LIMIT:
            self.index.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            base = len(self.index)
            need = base + len(new)
            if need > len(self.rows):
                size = max(need, 2 * len(self.rows))
                self.rows = np.concatenate((self.rows, np.zeros((size - len(self.rows), self.rows.shape[1]))))
                self.chars = np.concatenate((self.chars, np.zeros(size - len(self.chars))))
            self.rows[base:need] = self.model.score(new)
            self.chars[base:need] = [len(w) + 1 for w in new]
            self.index.update(zip(new, range(base, need), strict=True))
        return np.fromiter((self.index[w] for w in words), dtype=np.int64, count=len(words))

    def sums(self, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each group of words: log probability by language, characters, words."""
        sizes = np.fromiter((len(g) for g in groups), dtype=np.int64, count=len(groups))
        ids = self.ids([w for g in groups for w in g])
        of = np.repeat(np.arange(len(groups)), sizes)
        total = np.zeros((len(groups), self.rows.shape[1]))
        chars = np.bincount(of, weights=self.chars[ids], minlength=len(groups))
        for j in range(total.shape[1]):
            total[:, j] = np.bincount(of, weights=self.rows[ids, j], minlength=len(groups))
        return total, chars, sizes


class TextScores:
    """Sums of whole texts' prose words, each token worked out and each word scored once; starts anew beyond LIMIT tokens."""

    LIMIT = 400_000

    def __init__(self, model: CharModel):
        self.model = model
        self._start()

    def _start(self) -> None:
        self.read, self.rows, self.chars = WordNumbers(), np.zeros((1, len(self.model.languages))), np.zeros(1)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the prose words of all texts, one after the other, and the text of each; valid until the next call.

        sizes then has how many tokens of each text were looked at.
        """
        if len(self.read) > self.LIMIT:
            self._start()
        found, sizes, number = [np.zeros(0, np.int32)], [], self.read.__getitem__
        for text in texts:
            tokens = prose_tokens(text)
            sizes.append(len(tokens))
            found.append(np.fromiter(map(number, tokens), np.int32, len(tokens)))
        every = np.concatenate(found)
        at = np.flatnonzero(every)
        new = self.read.words[len(self.rows) :]
        self.rows = np.concatenate([self.rows, *(self.model.score(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        self.chars = np.concatenate((self.chars, np.fromiter((len(w) + 1 for w in new), np.float64, len(new))))
        self.sizes = sizes
        return every[at], np.repeat(np.arange(len(texts)), sizes)[at]

    def sums(self, words: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of so many texts, from numbers(): log probability by language, characters, words."""
        total = np.stack([np.bincount(of, weights=self.rows[words, j], minlength=texts) for j in range(self.rows.shape[1])], 1)
        return total, np.bincount(of, weights=self.chars[words], minlength=texts), np.bincount(of, minlength=texts)
