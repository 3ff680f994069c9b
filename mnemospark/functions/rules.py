"""Rules on the text of turns: signal, self-reference, kinds of facts, projects, hashes, clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark import params as P

#: White space as agents write it, the no-break space included; word edges that hold beside letters of any alphabet.
SPACE = r"[ \t\n\x0B\f\r\x{00A0}]"
EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# How narration starts.
NARRATION = rf"(?i)^(perfect|great|good|done|fixed|updated|sure|ok(ay)?|yes[.,! \t\n]|now let me|let me|i'?ll|i will|i'?m going to|first,? i|next,? i){EDGE_R}"
# Markers of durable knowledge by kind, the first that matches counts.
KINDS = (
    ("decision", rf"(?i){EDGE_L}(decided|decision|we('ll| will) go with|went with|chose|instead of|rather than|settled on){EDGE_R}"),
    ("gotcha", rf"(?i){EDGE_L}(gotcha|turns out|root cause|the (real )?(fix|problem|issue) (was|is)|beware|caveat|silently|doesn't actually|subtle(ty)?){EDGE_R}"),
    ("preference", rf"(?i){EDGE_L}(always|never|prefer|convention|from now on|by default|rule of thumb){EDGE_R}"),
    ("reference", rf"(?i){EDGE_L}(the (command|url|endpoint|path|port|token|config|file) (is|lives)|located at|listens on|port [0-9]{{2,5}}){EDGE_R}"),
)
# What agents inject as if the user had written it.
INJECTED_CONTEXT = r"(?i)^<(environment_context|user_instructions|permissions|apps_instructions|ide_|turn_context|collaboration_mode)"
INJECTED_PREFIX = r"^(Base directory for this skill|<command-|<system-reminder|<local-command)"


def strip(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def clip(text: Column, n: int, ellipsis: bool = False) -> Column:
    """The first n characters, with an ellipsis where something was cut."""
    cut = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(cut, F.lit("…"))).otherwise(text) if ellipsis else cut


def low_signal(role: Column, content: Column) -> Column:
    """True where a turn is too thin to be found by itself: short user turns, short or narrating others."""
    text = strip(content)
    n = F.length(text)
    return F.when(role == "user", n < P.LOW_USER).otherwise((n < P.LOW_OTHER) | ((n < P.LOW_NARRATION) & text.rlike(NARRATION)))


# Phrases by which a text is about the search tool; the caller's name of it stands for {tool}.
SELF_MARKERS = ("userpromptsubmit", "prompt-hook", "stop-hook", "auto-{tool}ed", "{tool}d", "{tool}-mcp", "{tool} daemon", "{tool} store", "{tool} hook")


def self_markers(tool: str) -> str:
    """The pattern of phrases by which a text is about the search tool of that name."""
    return "(?i)" + "|".join(SELF_MARKERS).format(tool=tool)


def self_referential(text: Column, tool: str) -> Column:
    """True where text is about the search tool: a marker, or its name three times."""
    return text.rlike(self_markers(tool)) | (F.regexp_count(text, F.lit(rf"(?i){EDGE_L}{tool}{EDGE_R}")) >= 3)


def asks_about_memory(query: Column, tool: str) -> Column:
    """True where a query is about memory itself, so matches about the tool are welcome."""
    return query.rlike(rf"(?i){tool}|memor(y|ies)|past session|userpromptsubmit|hook")


def kind_of(text: Column) -> Column:
    """The kind of durable knowledge that text holds, or null."""
    out = F.when(text.rlike(KINDS[0][1]), KINDS[0][0])
    for kind, pattern in KINDS[1:]:
        out = out.when(text.rlike(pattern), kind)
    return out


def injected_context(text: Column) -> Column:
    return text.rlike(INJECTED_CONTEXT) | ((F.length(text) > 6000) & text.startswith("<"))


def content_hash(text: Column) -> Column:
    """SHA-256 of text without regard to case and white space."""
    return F.sha2(F.regexp_replace(F.lower(strip(text)), rf"{SPACE}+", " "), 256)


def norm_path(path: Column) -> Column:
    """Forward slashes, none at the end, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"/+$", ""))


def project_of(cwd: Column, roots: list[tuple[str, str]] = ()) -> Column:
    """The label of the longest root (normalised path, label) that holds cwd, else its last part, else null."""
    plain = norm_path(cwd)
    base = F.element_at(F.split(F.regexp_replace(cwd, r"[\\/]+$", ""), r"[\\/]"), -1)
    out = F.when(cwd.isNull() | (cwd == ""), None)
    for root, label in sorted(roots, key=lambda r: -len(r[0])):
        out = out.when((plain == root) | plain.startswith(root + "/"), label)
    return out.otherwise(F.when(base != "", base))


def roots_from(text: str | None) -> list[tuple[str, str]]:
    """Roots of a setting like path=label;path=label: the last = of a part splits it, broken parts are left out."""
    out = []
    for part in (text or "").split(";"):
        path, eq, label = part.strip().rpartition("=")
        root = "/".join(x for x in path.strip().replace("\\", "/").split("/") if x).lower()
        root = ("/" if path.strip()[:1] in "\\/" else "") + root
        if eq and path.strip() and label.strip() and root:
            out.append((root, label.strip()))
    return out


def neutral_paths(text: Column, home: str) -> Column:
    """text with the home folder, however its slashes are written, as ~."""
    for variant in dict.fromkeys((home, home.replace("\\", "/"), home.replace("\\", "\\\\"))):
        text = F.replace(text, F.lit(variant), F.lit("~"))
    return text


def spoken(text: Column) -> Column:
    """text without Markdown marks, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[#*`_>|-]+", " "), rf"{SPACE}+", " "))


def turn_id(prefix: str, session: Column, role: Column, ts: Column, text: Column) -> Column:
    """An id from the content: the same message gets the same one whenever it is read."""
    return F.concat(F.lit(prefix + ":"), session, F.lit(":"), F.substring(F.sha1(F.concat(role, F.lit("\n"), F.coalesce(ts, F.lit("")), F.lit("\n"), text)), 1, 20))
