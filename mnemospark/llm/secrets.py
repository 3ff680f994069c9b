"""Credentials in code, configuration, commands and prose (problem 5).

A string is unnatural if a public tokenizer needs many subwords for its characters. Unnatural strings count where the
context says that a credential stands there: a vendor's format, a name, a header, an address with a login, a
sentence about a password. Redaction keeps every offset: a mask as long as the credential takes its place.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The file of the tokenizer's vocabulary, in ranks of tiktoken.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters a subword below which a string is unnatural: where a name says what it is, and where only a format does.
NAMED, BARE = 3.4, 2.9

#: No text of fewer characters holds a name or sign of a credential and the credential.
SHORTEST = 8
#: Formats of vendors' tokens; lengths are looser than for redaction at ingest, as the string must be unnatural besides.
VENDOR = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|github_pat_[0-9A-Za-z_]{22,}|sk-(?:ant-|proj-|svcacct-|admin-|or-)?[A-Za-z0-9_-]{24,}"
    r"|xox[abeprs]-[0-9A-Za-z-]{10,}|xapp-\d-[A-Za-z0-9-]{10,}|[srp]k_(?:live|test)_[0-9a-zA-Z]{16,}|whsec_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{30,}|ya29\.[0-9A-Za-z_-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|SK[a-f0-9]{32}|hf_[A-Za-z0-9]{30,}|glpat-[0-9A-Za-z_-]{18,}|vercel_[A-Za-z0-9]{20,}|nfp_[A-Za-z0-9]{30,}|tskey-[a-z]+-[A-Za-z0-9-]{10,}|dop_v1_[a-f0-9]{40,}|shp(?:at|ss|ca)_[a-fA-F0-9]{32}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_])"
)
KEY_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
OPEN_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:\s*[A-Za-z0-9+/=:, -]{16,})+")
#: Names of things that are secret, as the end of an identifier.
_NAME = (
    r"(?:secret(?:[_-]?(?:access)?[_-]?key)?|client[_-]?secret|token|_authToken|auth[_-]?token|access[_-]?token|refresh[_-]?token|passw(?:or)?d|passwd|pwd|passphrase|passcode|pass|api[_-]?key|apikey|app[_-]?key"
    r"|access[_-]?key(?:[_-]?id)?|private[_-]?key|key[_-]?data|signing[_-]?key|encryption[_-]?key|account[_-]?key|secret[_-]?key|auth(?:orization)?|credentials?|bearer|key)"
)
ASSIGNED = re.compile(
    rf"{_NAME}[\"'`]?\]?\s{{0,3}}(?:=>|:=|\?=|==?|:)\s{{0,3}}(?:[frb](?=[\"'`]))?(?:(?P<quote>[\"'`])(?P<quoted>[^\"'`\n]{{6,}})(?P=quote)|(?P<plain>[^\s\"'`]{{6,}}))", re.I
)
OPTION = re.compile(rf"(?<!\S)--?(?P<name>[a-z-]*{_NAME})[ =](?:[\"'](?P<quoted>[^\"'\n]{{6,}})[\"']|(?P<plain>[^\s\"'`=]{{6,}}))", re.I)
#: An address with its login is looked for within a run of such characters.
RUN = re.compile(r"[^\s'\"`<>]+")
USER = re.compile(r"[^:@/]*:")
HEADER = re.compile(r"\b(?:Bearer|Basic|Token|ApiKey|Digest)[ \t]+(?P<plain>[A-Za-z0-9+/=_.~\-]{12,})", re.I)
_PREFIX = re.compile(r"[A-Za-z0-9_.\-]*$")
#: A client's name, and the option of its line that takes a password.
CLIENT = re.compile(r"\b(?:mysql\w*|mariadb|sshpass|redis-cli|mongo(?:sh|dump)?|ldapsearch|smbclient|sqlcmd)\b")
CLIENT_OPTION = re.compile(r"\s-(?:p|a|w|P|W)[ =]?[\"']?(?P<plain>[^\s\"']{6,})")
USERPASS = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[^\s:\"']++:(?P<plain>[^\s\"']{6,})")
#: Words for a password in seven languages, and what stands between one and the password itself.
SPOKEN = re.compile(
    r"\b(?:pass(?:word|code|phrase)|passwort|kennwort|zugangscode|mot de passe|contrase[ñn]a|clave|senha|palavra-passe|wachtwoord|парол\w*|secret|token|api[- ]?key)(?:\s+(?:for\s+\S+|für\s+\S+|de\s+\S+|para\s+\S+|voor\s+\S+|account))?"
    r"(?:\s+|(?=[:=—–-]))(?:(?:is(?: now| currently| still)?|was|to|ist(?: jetzt)?|lautet|est|es|é|fue|foi|wordt|were|will be|of)\s|[:=—–-])?\s*[\"'`«„“]?(?P<plain>[^\s\"'`«»„“”]{8,})",
    re.I,
)

NOT_SECRET = re.compile(
    r"^(?:x+|\*+|\.+|-+|0+|1+|#+|(?:your|my|the|some|any|this|insert|enter|put|add)[-_ ].*|.*(?:change[-_ ]?me|changeit|placeholder|example|redacted|dummy|not[-_]?a[-_]?real|fake|sample|todo|fixme|secretkeyref|valuefrom|your[-_]|[-_]here).*"
    r"|<.*|.*>$|\[.*|\{.*|\(.*|\$.*|%[A-Za-z_]+%|@.*|&.*|env[:.].*|null|none|nil|true|false|undefined|process\.env.*|os\.(?:environ|getenv).*|getenv.*|getpass.*|vault:.*|secrets?[.:/].*|ssm:.*|arn:.*|op://.*|file:.*|sha\d+[-:].*|ssh-(?:rsa|ed25519|dss).*|ecdsa-.*|data:.*|https?:.*)$",
    re.I | re.S,
)
_HASHED = re.compile(r"^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\d+(?:\.\d+)*|\d{4}-\d\d-\d\d.*)$", re.I)
_PATHLIKE = re.compile(r"^(?:\.{0,2}[\\/]|[A-Za-z]:[\\/]|~[\\/])|^[\w.-]+(?:/[\w.-]+)+\.[a-z]{1,5}(?::\d+)?$")
_WORDS = re.compile(r"^[^\W\d]+(?:[-_. :/][^\W\d]+)*$")
_CALL = re.compile(r"^[A-Za-z_][\w.]*\(|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|^[A-Za-z_]\w*\[")
_SCHEME = re.compile(r"^(?:Bearer|Basic|Token|ApiKey|Digest)$", re.I)
#: Names that end like a secret but hold something else.
_OTHER = re.compile(r"(?:public|primary|foreign|sort|partition|cache|object|row|map|dict|hot|short|foreign|idempotency|dedup|translation|lookup|index|max|min|n|num|count|next|page|csrf|eos|bos|pad|unk|sep|cls|mask|by)[_.-]?(?:key|token|pass|auth)s?$", re.I)
_STRONG = re.compile(r"pass|pwd|secret", re.I)

#: A text without any of these, in lower case, holds no credential.
HINTS = (
    "private key", "secret", "token", "pass", "pwd", "key", "credential", "auth", "bearer", "basic ", "digest ", "-u ", "--user", "mysql", "mariadb", "redis-cli", "mongo", "ldapsearch", "smbclient", "sqlcmd",
    "akia", "asia", "abia", "acca", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "sk-", "xox", "xapp-", "k_live_", "k_test_", "whsec_", "aiza", "ya29.", "npm_", "pypi-", "sg.", "sk0", "sk1", "sk2", "sk3", "sk4", "sk5", "sk6", "sk7", "sk8", "sk9",
    "ska", "skb", "skc", "skd", "ske", "skf", "hf_", "glpat-", "vercel_", "nfp_", "tskey-", "dop_v1_", "shpat_", "shpss_", "shpca_", "eyj", "kennwort", "zugangscode", "contrase", "clave", "senha", "wachtwoord", "парол",
)


class Hints:
    """Whether texts may hold a credential: one scan for all hints at once where the package for it is there."""

    def __init__(self) -> None:
        try:
            import ahocorasick
        except ImportError:
            self.scan = None
            return
        self.scan = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for hint in HINTS:
            self.scan.add_word(hint)
        self.scan.make_automaton()

    def __call__(self, text: str) -> bool:
        if "://" in text and "@" in text:
            return True
        low = text.lower()
        if self.scan is None:
            return any(hint in low for hint in HINTS)
        return next(self.scan.iter(low), None) is not None


class Subwords:
    """Characters a subword under a public tokenizer."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

    def ratio(self, text: str) -> float:
        return len(text) / max(1, len(self.encoding.encode_ordinary(text)))


def _trim(value: str, quoted: bool) -> str:
    """A value without what belongs to the text around it: closing marks that weren't opened in it, final commas."""
    if quoted:
        return value
    value = re.split(r"[&;](?=\w+=)|\\[nr]|<|,(?=\S+[:=])", value)[0]
    while value:
        last = value[-1]
        if last in ",;:|\\" or last == "." or (last in ")]}>" and value.count({")": "(", "]": "[", "}": "{", ">": "<"}[last]) < value.count(last)):
            value = value[:-1]
        else:
            break
    return value


def _mixed(value: str) -> bool:
    return sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]")) >= 2


def _usable(value: str) -> bool:
    return bool(value) and not (NOT_SECRET.search(value) or _HASHED.search(value) or _WORDS.search(value) or _CALL.search(value)) and len(set(value)) >= 4


def _key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """From each marker that begins a private key to the next that ends one."""
    at = 0
    while (begin := KEY_BEGIN.search(text, at)) and (end := KEY_END.search(text, begin.end())):
        yield begin.start(), end.end()
        at = end.end()


def _logins(text: str) -> Iterator[tuple[int, int]]:
    """The passwords of addresses with a login: from the colon behind the user to the last @ before the next address."""
    if "://" not in text or "@" not in text:
        return
    for run in RUN.finditer(text):
        part, base = run[0], run.start()
        at = part.find("://")
        while at >= 0:
            after = part.find("://", at + 3)
            body = part[at + 3 : after if after >= 0 else None]
            user = USER.match(body)
            stop = body.rfind("@")
            while stop > 0 and not (body[stop + 1 : stop + 2].isalnum() or body[stop + 1 : stop + 2] in ("[", "_")):
                stop = body.rfind("@", 0, stop)
            if at and part[at - 1].isalnum() and user and stop >= user.end() + 3:
                yield base + at + 3 + user.end(), base + at + 3 + stop
            at = after


def _client_options(text: str) -> Iterator[re.Match]:
    """For a client in a line the next option that takes a password."""
    at = 0
    while client := CLIENT.search(text, at):
        line = text.find("\n", client.end())
        line = len(text) if line < 0 else line
        option = CLIENT_OPTION.search(text, client.end(), line)
        if option:
            yield option
        at = option.end() if option else line


def spans(text: str, subwords: Subwords) -> list[tuple[int, int]]:
    """Where the credentials of text are: (start, end) without overlap, in order. Empty for a text without any."""
    found: list[tuple[int, int, int]] = []
    if "PRIVATE KEY" in text:
        found += [(*block, 0) for block in _key_blocks(text)]
        blocks, opened = [f[0] for f in found], []
        for m in OPEN_KEY_BLOCK.finditer(text):
            # Blocks come in order, so only the last that begins before it can hold it.
            k = bisect_right(blocks, m.start()) - 1
            if k < 0 or found[k][1] <= m.start():
                opened.append((m.start(), m.start() + len(m[0].rstrip()), 0))
        found += opened
    for m in VENDOR.finditer(text):
        if subwords.ratio(m[0]) <= BARE and not re.search(r"(?i)example|placeholder|xxxx|your", m[0]):
            found.append((*m.span(), 1))
    for a, b in _logins(text):
        value = text[a:b]
        if not re.search(r"^(?:\$|\{|<|%[A-Za-z_]+%|\*+$|x+$)|(?i:password|passwd|changeme|secret)$|^\[REDACTED", value):
            found.append((a, b, 1))
    for pattern, rank in ((ASSIGNED, 2), (OPTION, 2), (HEADER, 2), (USERPASS, 2), (CLIENT, 2), (SPOKEN, 3)):
        for m in pattern.finditer(text) if pattern is not CLIENT else _client_options(text):
            groups = m.groupdict()
            kind = "quoted" if groups.get("quoted") else "plain"
            raw = groups.get(kind) or ""
            value = _trim(raw, kind == "quoted")
            start = m.start(kind)
            if kind == "quoted" and (s := re.match(r"(?:Bearer|Basic|Token)\s+", value, re.I)):
                start, value = start + s.end(), value[s.end() :]
            if len(value) < 6 or _SCHEME.match(value) or not _usable(value) or (kind == "quoted" and re.search(r"\s", value)):
                continue
            name = groups.get("name") or ""
            if pattern is ASSIGNED:
                head = text[m.start() : m.start(kind)]
                name = _PREFIX.search(text, max(0, m.start() - 60), m.start())[0] + re.match(r"[\w.-]*", head)[0]
            ratio = subwords.ratio(value)
            if ratio > 1.9 and _PATHLIKE.search(value):
                continue
            if rank == 3:  # only a sentence says so: it must look like a password
                good = _mixed(value) and bool(re.search(r"\d|[^\w.,:;'-]", value[:-1])) and ratio <= NAMED and not re.search(r"^[\w.-]+\.[a-z]{2,}(?:/|$)|^\w+\(", value)
            elif pattern is USERPASS or pattern is CLIENT:
                good = _mixed(value) and ratio <= NAMED
            elif pattern is HEADER:
                good = len(value) >= 12 and ratio <= BARE and bool(re.search(r"\d|[A-Z].*[a-z].*[A-Z]", value))
            elif _OTHER.search(name):
                good = False
            elif _STRONG.search(name):
                good = _mixed(value) and ratio <= NAMED
            else:
                good = len(value) >= 12 and ratio <= BARE and bool(re.search(r"\d|[A-Z].*[a-z].*[A-Z]", value))
            if good:
                found.append((start, start + len(value), rank))
    found.sort(key=lambda x: (x[2], x[0], -x[1]))
    kept: list[tuple[int, int]] = []
    for a, b, _ in found:
        k = bisect_right(kept, (a, b))
        if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
            kept.insert(k, (a, b))
    return kept


def mask(secret: str) -> str:
    """As many characters as the secret has, with its line breaks: code around it keeps its offsets and lines."""
    label = "REDACTED"
    plain = "".join(c if c in "\r\n" else "*" for c in secret)
    return label + plain[len(label) :] if len(secret) >= len(label) + 2 and "\n" not in secret[: len(label)] else plain


def redact_spans(text: str, where: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in where:
        out += [text[at:a], mask(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, columns: list[str], keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each text with credentials: the columns of keep, field, secrets, starts, redacted.

    secrets has each credential of the text in order, repeated ones too; redacted has the text's length. Null and empty
    texts have none. The texts go through in Arrow batches, without a shuffle; those without any hint are passed over.
    The vocabulary goes with the tasks; its size doesn't depend on the data.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns))
    rows = df.select(*keep, F.explode(F.filter(fields, lambda x: F.length(x["text"]) >= SHORTEST)).alias("__f")).select(*keep, "__f.field", "__f.text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, hinted = Subwords(blob.value), Hints()
        for batch in batches:
            where = [spans(t, subwords) if hinted(t) else [] for t in batch["text"]]
            hit = [bool(w) for w in where]
            if not any(hit):
                continue
            texts = batch["text"][hit].tolist()
            found = [w for w in where if w]
            yield batch.loc[hit, [*keep, "field"]].assign(
                secrets=[[t[a:b] for a, b in w] for t, w in zip(texts, found, strict=True)],
                starts=[[a for a, _ in w] for w in found],
                redacted=[redact_spans(t, w) for t, w in zip(texts, found, strict=True)],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return rows.mapInPandas(run, f"{kinds}, field string, secrets array<string>, starts array<int>, redacted string")
