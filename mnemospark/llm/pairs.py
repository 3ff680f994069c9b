"""Defects of prompt and response pairs (problem 4): ordered rules, every one that holds is reported."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import is_blank, speaker
from mnemospark.llm import endings, language
from mnemospark.llm.charlm import CharModel, TextScores, without_accents
from mnemospark.llm.conversations import order_turns, session_defects
from mnemospark.llm.prose import CAMEL, WORD, formatted
from mnemospark.storage import materialize

#: Nats by which a text's language must lead to be compared.
MIN_LEAD = 8.0
#: Bits that tell which words two texts can't share.
BITS = 128
#: Rows whose texts are asked for go with the tasks up to this number, beyond it by a join.
MAX_BROADCAST_ROWS = 2_000_000
#: The pairs' rules in order.
DEFECTS = ("empty_answer", "truncated_answer", "refusal", "copied_question", "other_language")

def _patterns(own: str, plain: str, mine: str, declines: str, later: str) -> tuple[re.Pattern, re.Pattern]:
    """A language's pattern of declining, and that of what only puts off.

    own: first person with a negated modal; plain: verbs that need no object to mean the request; mine: verbs with an
    object that points at the request or at the one who asks; declines: phrases that decline by themselves.
    """
    return re.compile(rf"(?:{own})[^.!?]{{0,60}}?\b(?:(?:{plain})\b|(?:{mine}))|{declines}", re.S), re.compile(rf"\b(?:{later})\b")


#: How a request is declined, by language, in lower case and without accents. A negation of any other verb
#: ("I can't reproduce it") speaks about the matter and declines nothing.
REFUSALS = {
    "en": _patterns(
        r"\b(?:i|we)(?:'m|'re| am| are)? (?:just |simply |really )?(?:can(?:'t|not| not)|could(?:n't| not)|won't|will not|would(?:n't| not)|(?:not able|unable) to|not going to|do(?:n't| not) feel comfortable|'d rather not|would rather not|would prefer not to|refuse to|decline to)\b|\bi'd (?:rather not|prefer not to)\b|\b(?:unable|not able) to\b",
        r"help|assist|comply|oblige|be of (?:help|assistance)",
        r"(?:do|write|create|produce|generate|give|provide|share|carry out|perform|fulfil+|answer|complete|execute|support|discuss|process|handle|take on|continue with|proceed with|go along with|engage with|offer|make)(?: you)? (?:that|this|it|so|such|your|any of|these|those|what you)\b|carry (?:that|this|it) out|(?:do|write|give|carry|perform|make)\b[^.!?]{0,40}\bfor you\b",
        r"\b(?:i|we)(?:'ll| will)? (?:must|have to|need to) (?:respectfully |politely )?(?:decline|refuse|pass on (?:this|that|it)|turn (?:this|that|it|you) down)\b|\b(?:request|something|that|this|it)\b[^.!?]{0,20}\b(?:i|we)(?:'ll| will)? (?:must|have to|need to) (?:decline|refuse|turn down)\b|\bi (?:decline|refuse) (?:this|that|your)\b"
        r"|\b(?:i|we)\b[^.!?]{0,12}\bnot (?:permitted|allowed|authori[sz]ed) to\b|\b(?:outside|beyond|against) (?:of )?(?:what (?:i|we)(?:'m|'re| am| are| can| may)|my (?:guidelines|polic|rules|scope|abilit|capabilit|permissions)|our (?:guidelines|polic|rules))|\bas an? (?:ai|assistant|language model)\b[^.!?]{0,60}\b(?:not|cannot|can't|unable)\b|\bnot (?:something|a thing) (?:that )?(?:i|we)(?:'m| am| can| will)",
        r"until|before|as long as",
    ),
    "de": _patterns(
        r"(?:\b(?:ich|wir) (?:kann|darf|mochte|werde|konnen|durfen|werden)\b|\b(?:kann|darf|mochte|werde|konnen|durfen|werden) (?:ich|wir)\b)[^.!?]{0,60}\b(?:nicht|kein\w*)",
        r"(?:weiter)?helfen|behilflich sein|nachkommen|dienen",
        r"(?<=fur dich nicht )\w+|(?<=fur sie nicht )\w+|(?<=dir nicht )(?:geben|schreiben|beantworten)|(?<=ihnen nicht )(?:geben|schreiben|beantworten)|(?:fur (?:dich|sie|euch) )?(?:tun|erledigen|durchfuhren|ausfuhren|beantworten|erfullen|ubernehmen|unterstutzen)\b",
        r"\b(?:muss|mochte|werde|will) (?:ich|wir)\b[^.!?]{0,40}\b(?:ablehnen|verweigern|zuruckweisen)\b|\b(?:ich|wir) (?:muss|mussen|mochte|werde)\b[^.!?]{0,60}\b(?:ablehnen|verweigern|zuruckweisen)\b|\b(?:lehne|verweigere) ich\b|\bich (?:lehne|verweigere)\b[^.!?]{0,40}\b(?:anfrage|bitte|wunsch|das|dies)|\bist (?:mir|uns)\b[^.!?]{0,15}\bnicht (?:gestattet|erlaubt)|\b(?:ich bin|bin ich)\b[^.!?]{0,30}\bnicht (?:befugt|berechtigt|in der lage)",
        r"bis|solange|bevor",
    ),
    "fr": _patterns(
        r"\b(?:je|nous) ne (?:peux|puis|pourrai|pouvons|souhaite|veux|dois|saurais|suis)\b[^.!?]{0,20}\b(?:pas\b)?|\bne m'est pas possible de|\bimpossible (?:pour moi )?de",
        r"(?:vous|t'|te |l')? ?aider|y repondre|donner suite|collaborer",
        r"(?:faire|ecrire|executer|realiser|effectuer|fournir|accomplir|traiter|satisfaire|repondre a) (?:cela|ca|ceci|cette|ce|cet|votre|ta|tout cela)\b|(?:le|la) faire pour (?:vous|toi)",
        r"\bje (?:dois|me vois (?:oblige\w*|contraint\w*) de|prefere)\b[^.!?]{0,20}\b(?:refuser|decliner)\b|\bje (?:refuse|decline) (?:de|d'|cette|ce|votre|ta)\b|\bne m'est pas\b[^.!?]{0,12}\b(?:permis|autorise)|\bje ne suis pas\b[^.!?]{0,15}\b(?:autorise|habilite|en droit)|\bil m'est interdit",
        r"tant que|jusqu|avant que",
    ),
    "es": _patterns(
        r"\bno (?:puedo|podemos|podre|debo|quiero|voy a|me es posible|estoy en condiciones de)\b",
        r"ayudar\w*|colaborar|atender\w*",
        r"(?:hacer|realizar|ejecutar|escribir|cumplir|responder|proporcionar|completar|dar)(?:te|le)?(?: con| a)? (?:eso|esto|ese|esa|este|esta|tu|su)\b|(?:hacer|escribir|dar)(?:te|se)lo\b|hacerlo por (?:ti|usted)",
        r"\b(?:tengo que|debo|prefiero|he de) (?:rechazar|negarme|declinar)|\bme niego a\b|\brechazo (?:esta|este|tu|su)\b|\bno (?:me esta|me es|se me|estoy|tengo)\b[^.!?]{0,15}\b(?:permit\w*|autorizad\w*|permiso)",
        r"hasta que|mientras|antes de",
    ),
    "pt": _patterns(
        r"\bnao (?:posso|podemos|poderei|consigo|devo|quero|vou|me e possivel|estou em condicoes de)\b",
        r"(?:te |o |a |lhe |vos )?ajud\w+|colaborar|atender",
        r"(?:fazer|executar|realizar|escrever|cumprir|responder|fornecer|dar)(?:-lhe)?(?: com| a)? (?:isso|isto|esse|essa|este|esta|o seu|o teu)\b|fazer isso por (?:ti|voce)",
        r"\b(?:tenho de|tenho que|devo|prefiro) (?:recusar|negar|declinar)|\brecuso(?:-me)?\b|\bnao (?:me (?:e|foi|esta)|estou|tenho|sou)\b[^.!?]{0,15}\b(?:permitid\w*|autorizad\w*|permissao)",
        r"ate que|enquanto|antes de",
    ),
    "nl": _patterns(
        r"(?:\b(?:ik|wij|we) (?:kan|mag|wil|zal|kunnen|mogen|zullen)\b|\b(?:kan|mag|wil|zal) (?:ik|wij|we)\b)[^.!?]{0,60}\bniet",
        r"(?:mee |bij )?(?:helpen|bijstaan|meewerken)",
        r"(?:voor (?:je|jou|u) )?(?:uitvoeren|doen|beantwoorden|voldoen|leveren)\b|voor (?:je|jou|u) \w+",
        r"\bmoet ik\b[^.!?]{0,40}\b(?:weigeren|afwijzen|afslaan)\b|\bik moet\b[^.!?]{0,40}\b(?:weigeren|afwijzen|afslaan)\b|\bik (?:weiger|wijs)\b[^.!?]{0,30}\b(?:dit|dat|verzoek|af)\b|\bis (?:mij|me) niet toegestaan|\b(?:ik ben|ben ik)\b[^.!?]{0,20}\bniet (?:bevoegd|gemachtigd|in staat)",
        r"totdat|zolang|voordat",
    ),
    "ru": _patterns(
        r"\bне (?:могу|можем|смогу|буду|стану|в состоянии)\b",
        r"помо\w+",
        r"(?:выполн\w+|сделать|ответить|написать|предоставить|исполнить|удовлетворить)(?: на| для вас| вам| тебе)? ?(?:эт\w+|ваш\w*|тво\w+|так\w+)|(?:эт\w+|ваш\w*|так\w+)(?: \w+)? (?:выполн\w+|сделать|исполнить)",
        r"\bвынужден\w*[^.!?]{0,20}(?:отказ|отклон)|\bотказываюсь\b|\b(?:должен|должна|придется)[^.!?]{0,20}(?:отказ|отклон)|\bмне (?:нельзя|запрещено|не разрешено|не позволено|не положено)|\bне имею права\b",
        r"пока|прежде чем",
    ),
}
#: After one of these a sentence that declined goes on to say something.
GOES_ON = re.compile(r"[,;:–—-] ?(?:but|however|though|instead|aber|jedoch|sondern|allerdings|mais|cependant|pero|sino|aunque|mas|porem|maar|echter|но|однако|зато)\b(.*)", re.S)
#: What may stand beside a refusal without giving an answer.
POLITE = re.compile(
    r"^(?:sorry|unfortunately|regrettably|apologies|i apologi[sz]e|i'?m (?:very |so )?sorry|no|nope|es tut mir leid|leider|entschuldigung|nein|desole|je suis desole|malheureusement|non|lo siento|lamentablemente|por desgracia|perdon|lamento|desculpe?|infelizmente|nao|het spijt me|helaas|nee|извините|простите|к сожалению|нет|please (?:ask|contact|try)|let me know|is there (?:anything|something) else)\b"
)
#: Words that a polite phrase, or what follows a "but" after it, may have without being an answer.
POLITE_WORDS = 10
#: An answer copies where so large a share of the question comes back in order, and of the answer's words beyond an
#: introduction only such a share is changed.
COPIED, CHANGED = 0.6, 0.2
#: What may introduce a copy: up to so many words with a colon behind them, or so many without one.
INTRODUCED, LED_IN = 12, 4
_STOP = re.compile(r"(?<=[.!?…])\s+|\n+")
_LEAD = re.compile(r"^[^\n:]*:\s")
_EDGES = re.compile(r"^\W+|\W+$")
_NAME = re.compile(r"\d|\w[^\w'’]\w|_|" + CAMEL.pattern)


def _bare(text: str) -> str:
    text = text.lower().replace("’", "'").replace("ё", "е")
    return text if text.isascii() else " ".join(without_accents(w) for w in text.split())


def _declines(sentence: str, languages: tuple[str, ...]) -> bool:
    for lang in languages:
        pattern, later = REFUSALS[lang]
        m = pattern.search(sentence)
        if m and not later.search(sentence, m.end()):
            rest = GOES_ON.search(sentence, m.end())
            if not rest or len(WORD.findall(rest[1])) < 3:
                return True
    return False


def is_refusal(answer: str, lang: str = "") -> bool:
    """True if the answer has a sentence that declines the request, and none that says anything else.

    lang, if it is known, leaves only the phrases of that language.
    """
    languages = (lang,) if lang in REFUSALS else tuple(REFUSALS)
    declined, at, answer = False, 0, answer.strip()
    while at < len(answer):
        stop = _STOP.search(answer, at)
        part, at = answer[at : stop.start() if stop else None], stop.end() if stop else len(answer)
        if not WORD.search(part):
            continue
        plain = _bare(part).strip(" *_>-")
        if _declines(plain, languages):
            declined = True
        elif not (POLITE.search(plain) and len(WORD.findall(plain)) <= POLITE_WORDS):
            return False
    return declined


def _tokens(text: str) -> list[str]:
    """The tokens of text without the marks around them; a name or path is one token, words are in lower case."""
    return [t if _NAME.search(t) else t.lower() for t in (_EDGES.sub("", x) for x in text.split()) if t]


def is_copy(question: str, answer: str) -> bool:
    """True if the answer gives back the question, slightly altered or introduced, and nothing else.

    Names may take the place of words, and a few words may be replaced or left out. Words added inside or behind are an
    answer; so is a statement made of a question by changing, leaving out or adding any of its words.
    """
    raw, limit = len(answer.split()), len(question.split())
    if not limit or raw > 1.2 * limit + INTRODUCED + 4 or raw < COPIED * limit - 4:
        return False
    q, a = _tokens(question), _tokens(answer)
    if answer.isupper():
        q = [x.upper() for x in q]
        a = [x.upper() for x in a]
    if not q or len(a) < COPIED * len(q):
        return False
    if sum((Counter(q) & Counter(a)).values()) < COPIED * len(q):
        return False
    lead = _LEAD.match(answer)
    if lead:
        front = _tokens(lead[0])
        if len(front) <= INTRODUCED and [x.lower() for x in front] != [x.lower() for x in q[: len(front)]]:
            a = a[len(front) :]
    stated = "?" in question and "?" not in answer
    same = changed = 0
    for what, i1, i2, j1, j2 in SequenceMatcher(None, q, a, autojunk=False).get_opcodes():
        words = sum(not _NAME.search(x) for x in a[j1:j2])
        if what == "equal":
            same += i2 - i1
        elif what == "delete":
            changed += len(q) if stated else 0
        elif what == "insert":
            changed += len(q) if stated or j1 and j2 == len(a) and words or j2 > LED_IN and not j1 else words if j1 else 0
        else:
            changed += len(q) if stated and words or j2 - j1 > i2 - i1 + 2 else words
    return same >= COPIED * len(q) and changed <= max(1, CHANGED * len(q))


def text_languages(words: np.ndarray, of: np.ndarray, texts: int, scores: TextScores) -> tuple[list[str], list[float]]:
    """For each of so many texts by the numbers of its prose words: the language or "", and its lead in nats."""
    which, lead = language.best(scores.model, *scores.sums(words, of, texts))
    return [scores.model.languages[j] if j >= 0 else "" for j in which], lead.tolist()


def answered_pairs(turns: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """question_row and answer_row: a user's turn with content and the assistant's turn right after it.

    Sessions that are empty or broken give no pairs.
    """
    ordered, others = order_turns(turns)
    dropped = session_defects(ordered, others, sessions).where("defect IN ('empty', 'broken')").select("session_id")
    asked = ordered.where("speaker = 'user' AND NOT blank AND next_speaker = 'assistant'")
    return asked.join(dropped, "session_id", "left_anti").select(F.col("row_id").alias("question_row"), F.col("next_row").alias("answer_row"))


class _Bits:
    """The bit of each prose word among BITS, by its number in scores, worked out once."""

    def __init__(self, scores: TextScores):
        self.scores, self.words, self.each = scores, scores.read.words, np.zeros((0, 2), np.uint64)

    def of(self, words: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
        """The bits of the words of so many texts, as scores numbers them, in two signed numbers each."""
        if self.words is not self.scores.read.words:  # it started anew
            self.words, self.each = self.scores.read.words, self.each[:0]
        bits = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BITS for w in self.words[len(self.each) :]]
        self.each = np.concatenate((self.each, np.array([(1 << b, 0) if b < 64 else (0, 1 << b - 64) for b in bits], np.uint64).reshape(-1, 2)))
        found = np.zeros((texts, 2), np.uint64)
        if len(words):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            found[of[first]] = np.bitwise_or.reduceat(self.each[words], first)
        return found.view(np.int64)


TRAITS = "row_id long, id string, answers boolean, blank boolean, lang string, lead double, cut boolean, odds double, refused boolean, tokens int, bits1 long, bits2 long, step int, n long"


def traits(turns: DataFrame, model: endings.EndModel, languages: CharModel) -> DataFrame:
    """What the rules need of each speaker's turn, in one pass over the texts and without a shuffle.

    row_id, id (of answers), answers, blank, the language of the prose and its lead in nats, whether an answer is cut, or the log-odds that
    the threshold decides on, whether it is a refusal, the number of tokens and the bits of the prose words. The same
    pass calibrates: rows with a step say how many cases (n) of the held-out texts of a language, cut or not, fall into it.
    """
    blob = turns.sparkSession.sparkContext.broadcast(pickle.dumps((model, languages)))
    names = [x.split()[0] for x in TRAITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends, langs = pickle.loads(blob.value)
        scores, cases = TextScores(langs), Counter()
        bits = _Bits(scores)
        for batch in batches:
            texts, answers = batch["content"].fillna("").tolist(), batch["answers"].to_numpy(bool)
            full = ~batch["blank"].to_numpy(bool)
            words, of = scores.numbers(texts)
            lang, lead = text_languages(words, of, len(texts), scores)
            found = bits.of(words, of, len(texts))
            # An answer with words outside plain prose may hold any word.
            forms = np.fromiter(map(formatted, texts), bool, len(texts))
            found[answers & forms] = -1
            tokens = [len(t.split()) if form else n for t, form, n in zip(texts, forms.tolist(), scores.sizes, strict=True)]
            cut, odds, refused = np.full(len(texts), False, object), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
            asked = np.flatnonzero(answers & full)
            cut[asked], odds[asked] = endings.shifted_odds([texts[i] for i in asked], ["turns"] * len(asked), ends)
            refused[asked] = [is_refusal(texts[i], lang[i] if lead[i] >= MIN_LEAD else "") for i in asked]
            held = np.flatnonzero(batch["held"].to_numpy(bool))
            cases.update(endings.held_scores([texts[i] for i in held], ["turns"] * len(held), ends, scores, [lang[i] for i in held]))
            none = pd.array([None] * len(texts), "Int64")
            out = batch[["row_id", "id", "answers", "blank"]].assign(lang=lang, lead=lead, cut=cut, odds=odds, refused=refused, tokens=tokens, bits1=found[:, 0], bits2=found[:, 1], step=none, n=none)
            yield out[batch["speaks"].to_numpy(bool)]
        yield pd.DataFrame([(lang, cut, step, n) for (lang, _, cut, step), n in cases.items()], columns=["lang", "cut", "step", "n"]).reindex(columns=names).astype(object)

    who, content = speaker(F.col("role")), F.col("content")
    blank, speaks = is_blank(content), F.coalesce(who.isin("user", "assistant"), F.lit(False))
    rows = turns.select("row_id", F.when(who == "assistant", F.col("id")).alias("id"), "content", speaks.alias("speaks"), F.coalesce(who == "assistant", F.lit(False)).alias("answers"), blank.alias("blank"))
    rows = rows.withColumn("held", ~F.col("blank") & endings.is_held_out(F.xxhash64("content"))).where("speaks OR held")
    return rows.mapInPandas(run, TRAITS)


def _copies(pairs: DataFrame, turns: DataFrame) -> DataFrame:
    """answer_id of the pairs (question_row, answer_row, answer_id) whose answer gives back the question."""
    needed = pairs.select(F.explode(F.array("question_row", "answer_row")).alias("row_id")).distinct()
    if pairs.count() <= MAX_BROADCAST_ROWS // 2:
        needed = F.broadcast(needed)
    texts = materialize(turns.select("row_id", "content").join(needed, "row_id", "left_semi"), "pair-texts")
    both = pairs.join(texts.select(F.col("row_id").alias("question_row"), F.col("content").alias("question")), "question_row")
    both = both.join(texts.select(F.col("row_id").alias("answer_row"), F.col("content").alias("answer")), "answer_row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [is_copy(q, a) for q, a in zip(batch["question"], batch["answer"], strict=True)]
            yield batch.loc[same, ["answer_id"]]

    return both.select("answer_id", "question", "answer").mapInPandas(run, "answer_id string")


def pair_defects(turns: DataFrame, samples: DataFrame, sessions: DataFrame | None = None, min_lead: float = MIN_LEAD) -> DataFrame:
    """answer_id and defect: one row for each defect of each pair.

    A null or blank answer is empty_answer and nothing else. The language of an answer is compared only where both
    texts have enough prose for a lead of min_lead nats; code has no language. Texts are read where they lie; only
    those of pairs that may be copies, by their lengths and the bits of their words, are moved.
    """
    texts = turns.select("row_id", "id", "content", F.lit("turns").alias("tbl")).where(~is_blank(F.col("content")))
    found = materialize(traits(turns, *endings.train(texts, samples, rows=turns.count(), calibrated=False)), "traits")
    limits = endings.summed_thresholds(found.where("step IS NOT NULL").withColumn("tbl", F.lit("turns")))
    each = found.where("step IS NULL").drop("step", "n")
    q = each.where("NOT answers AND NOT blank").select(F.col("row_id").alias("question_row"), *(F.col(c).alias(f"q_{c}") for c in ("lang", "lead", "tokens", "bits1", "bits2")))
    a = each.where("answers").select(F.col("row_id").alias("answer_row"), *(F.col(c).alias(f"a_{c}") for c in each.columns if c not in ("row_id", "answers")))
    both = materialize(answered_pairs(turns, sessions).join(q, "question_row").join(a, "answer_row"), "pairs")
    limit = F.lit(limits[("", "")])
    for (lang, column), x in limits.items():
        limit = F.when(F.col("a_lang") == lang, x).otherwise(limit) if column == "turns" else limit
    sure = (F.col("q_lang") != "") & (F.col("a_lang") != "") & (F.least("q_lead", "a_lead") >= min_lead)
    rules = {
        "empty_answer": F.col("a_blank"),
        "truncated_answer": F.coalesce("a_cut", F.col("a_odds") < limit) & ~F.col("a_blank"),
        "refusal": F.col("a_refused") & ~F.col("a_blank"),
        "other_language": sure & (F.col("q_lang") != F.col("a_lang")) & ~F.col("a_blank"),
    }
    defects = F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))
    found = both.select(F.col("a_id").alias("answer_id"), defects.alias("defect"))
    lost = F.bit_count(F.col("q_bits1").bitwiseAND(F.bitwise_not("a_bits1"))) + F.bit_count(F.col("q_bits2").bitwiseAND(F.bitwise_not("a_bits2")))
    near = both.where((F.col("a_tokens") <= 1.2 * F.col("q_tokens") + INTRODUCED + 4) & (F.col("a_tokens") >= COPIED * F.col("q_tokens") - 4))
    near = near.where((lost <= (1 - COPIED) * F.col("q_tokens")) & ~F.col("a_refused") & ~F.col("a_blank"))
    copies = _copies(near.select("question_row", "answer_row", F.col("a_id").alias("answer_id")), turns)
    return found.unionByName(copies.select("answer_id", F.lit("copied_question").alias("defect")))
