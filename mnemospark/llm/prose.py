"""Splitting texts into prose and the rest: code, log lines, paths, names and quoted phrases.

Plain Python over whole texts, used inside Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)", re.M)
INLINE_CODE = re.compile(r"`[^`\n]*`")
QUOTED = re.compile(r"\"[^\"\n]*\"|«[^»\n]*»|„[^“”\"\n]*[“”\"]|“[^”\n]*”")
LIST_MARK = re.compile(r"^\s{0,3}(?:[-*+•>]|\d{1,3}[.)]|→)\s+")
SENTENCE = re.compile(r"\S.*?(?:[.!?…]+[\"'»”)\]]*(?=\s|$)|$)", re.S)
COMPLETE = re.compile(r"[.!?…][\"'»”)\]]*$")
#: A token of prose: letters only, at most an apostrophe inside, with its punctuation.
PROSE_TOKEN = re.compile(r"(?<!\S)[(\[¿¡'’*_]*([^\W\d_]+(?:['’][^\W\d_]+)*)[)\]'’*_]*[.,;:!?…]*(?!\S)")
_QUOTE = re.compile(r"[\"«„“]")
#: Signs that a text is more than lines of plain prose: code, quotes, headings, indented lines.
_FORMS = ("`", '"', ">", "~~~", "\n#", "\n ", "\n\t", "«", "„", "“")
#: A capital letter after a small one marks a name of a program.
CAMEL = re.compile(r"[a-zа-яß-öø-ÿ][A-ZА-Я]")
WORD = re.compile(r"[^\W_]+")


def plain_lines(text: str) -> Iterator[tuple[int, str, bool]]:
    """(offset, line, is_heading) of the lines of text that are not code: no fenced block, no line indented as code."""
    fence, at = "", 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        mark = FENCE.match(line)
        if mark:
            if not fence:
                fence = mark[1][0]
            elif mark[1][0] == fence:
                fence = ""
            continue
        if fence or not line.strip() or line.startswith(("    ", "\t")):
            continue
        yield start, line, line.lstrip().startswith("#")


def formatted(text: str) -> bool:
    """False only for texts all of whose tokens belong to plain prose."""
    if text[:1] in ("#", " ", "\t"):
        return True
    for form in _FORMS:
        if form in text:
            return True
    return False


def _blank_out(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def sentences(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, sentence, complete) of the prose of text; headings are no sentences.

    Code in backticks and quoted phrases are blanked, so offsets hold in the original text. A sentence is complete if
    it ends with a final mark.
    """
    for at, line, heading in plain_lines(text):
        if heading:
            continue
        line = QUOTED.sub(_blank_out, INLINE_CODE.sub(_blank_out, line))
        mark = LIST_MARK.match(line)
        begin = mark.end() if mark else 0
        for m in SENTENCE.finditer(line, begin):
            yield at + m.start(), at + m.end(), m[0], bool(COMPLETE.search(m[0].rstrip()))


def prose_words(sentence: str) -> list[str]:
    """The words of a sentence in lower case, without names of programs, numbers and paths."""
    return [w.lower() for w in PROSE_TOKEN.findall(sentence) if not CAMEL.search(w)]


def _prose_word(token: str) -> str:
    """The word of a token of prose in lower case, "" for any other token."""
    if token.isalpha():
        core = token
    elif "/" in token or token[0].isdecimal() or not (m := PROSE_TOKEN.fullmatch(token)):
        return ""
    else:
        core = m[1]
    return core if core.islower() else "" if CAMEL.search(core) else core.lower()


def prose_tokens(text: str) -> list[str]:
    """The tokens of the lines of text that sentences() reads, in order."""
    if not formatted(text):
        return text.split()
    out: list[str] = []
    for _, line, heading in plain_lines(text):
        if heading:
            continue
        if "`" in line:
            line = INLINE_CODE.sub(_blank_out, line)
        if _QUOTE.search(line):
            line = QUOTED.sub(_blank_out, line)
        out += line.split()
    return out


class ProseWords(dict):
    """The prose words of whole texts; what a token gives is worked out once, as tokens come again and again."""

    LIMIT = 200_000

    def __missing__(self, token: str) -> str:
        word = _prose_word(token)
        if len(self) > self.LIMIT:
            self.clear()
        self[token] = word
        return word

    def of(self, text: str) -> list[str]:
        """The same words, in order, that prose_words gives for the sentences of text."""
        return [w for w in [self[t] for t in prose_tokens(text)] if w]


class WordNumbers(dict):
    """The same words as numbers: each token's, 0 for one that isn't prose, and the words by number."""

    def __init__(self) -> None:
        super().__init__()
        self.words, self.number = [""], {"": 0}

    def __missing__(self, token: str) -> int:
        n = self[token] = self.of_word(_prose_word(token))
        return n

    def of_word(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.words)
            self.words.append(word)
        return n


#: A final mark at the end of a token.
_FINAL = re.compile(r"[.!?…]+[\"'»”)\]]*\Z")
_LAST = frozenset(".!?…\"'»”)]")


class SentenceWords(WordNumbers):
    """The prose words of the sentences of whole texts as numbers, each token worked out once.

    Tokens are numbered too, from 1 on, and have a code by number. It is twice twice the number of its word (0: none), and tells whether a sentence ends behind it: 2 within
    a sentence, 1 as its first token, where the first character isn't looked at.
    """

    #: The code behind each line.
    LINE = 3

    def __init__(self) -> None:
        super().__init__()
        self.code = [self.LINE]

    def __missing__(self, token: str) -> int:
        code = self.of_word(_prose_word(token)) << 2
        if token[-1] in _LAST and _FINAL.search(token):
            code |= 3 if _FINAL.search(token, 1) else 2
        n = self[token] = len(self.code)
        self.code.append(code)
        return n

    def codes(self, text: str) -> list[int]:
        """The codes of the tokens that sentences() reads, line by line."""
        return [self.code[i] for i in self.ids(text, formatted(text))]

    def ids(self, text: str, form: bool) -> list[int]:
        """The numbers of these tokens, 0 behind each line. form: whether the text is formatted."""
        out: list[int] = []
        if form:
            lines = [INLINE_CODE.sub(_blank_out, line) if "`" in line else line for _, line, heading in plain_lines(text) if not heading]
            lines = [QUOTED.sub(_blank_out, line) if _QUOTE.search(line) else line for line in lines]
        else:
            lines = text.split("\n")
        for line in lines:
            # Only what starts with a space, a mark or a number may be an entry of a list.
            if not line[:1].isalpha() and (mark := LIST_MARK.match(line)):
                line = line[mark.end() :]
            out += [self[t] for t in line.split()]
            out.append(0)
        return out
