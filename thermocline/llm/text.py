"""Reading forum posts: plain words, and the author's own prose."""

from __future__ import annotations

import html
import re
import unicodedata

# Tags of forum markup, in angle or square brackets.
TAG_NAMES = (
    "a abbr b big blockquote br center cite code color del div em font h1 h2 h3 h4 h5 h6 hr i img ins kbd li list ol p pre q quote s samp size small span "
    "spoiler strike strong sub sup table tbody td th thead tr tt u ul url"
).split()
_TAG = re.compile(r"</?(?:" + "|".join(TAG_NAMES) + r")\b[^<>]*>|\[/?(?:" + "|".join([*TAG_NAMES, r"\*"]) + r")(?:[=\s][^\[\]\n]*)?\]|<!--.*?-->", re.I | re.S)
_REPLY_MARK = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def unescape(text: str) -> str:
    """Without entities, also where they were escaped twice."""
    for _ in range(3):
        if "&" not in text:
            break
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return text


def fold(text: str) -> str:
    """Lower case without accents and invisible characters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).casefold()
    return unicodedata.normalize("NFKD", _MARK.sub("", unicodedata.normalize("NFKD", text)))


def words(text: str | None) -> list[str]:
    """Words of a text, where markup, entities, reply marks, line breaks, punctuation, invisible characters, case and accents don't matter."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _REPLY_MARK.sub(" ", _TAG.sub(lambda m: "\n" if m[0][:3].lower() in ("<br", "</p", "<p>") or m[0][0] == "[" else " ", unescape(text)))
    return _WORD.findall(fold(text))


# How quoted posts, signatures and pasted machine text are marked off.
_QUOTE_OPEN_CLOSE = re.compile(r"\[(/?)quote\b[^\[\]]*\]|<(/?)blockquote\b[^<>]*>", re.I)
_CODE = re.compile(r"\[code\b[^\]]*\].*?(?:\[/code\]|\Z)|<pre\b[^>]*>.*?(?:</pre>|\Z)|<code\b[^>]*>.*?(?:</code>|\Z)|```.*?(?:```|\Z)", re.I | re.S)
_BREAK = re.compile(r"<br\s*/?>|</?p\b[^>]*>|</?div\b[^>]*>", re.I)
_SMALL = re.compile(r"\[size=1\].*?(?:\[/size\]|\Z)|<small\b[^>]*>.*?(?:</small>|\Z)", re.I | re.S)
_SIGNATURE_LINE = re.compile(r"^\s*(?:--\s*|_{2,}\s*|—\s*|~ .{1,60} ~\s*)$")
_ATTRIBUTION = re.compile(r"^\s*\S{2,40}(?: (?:wrote|said|posted|posted earlier|schrieb|meinte|sagte|a écrit|écrivait|disait|a dit|escribió|dijo|decía|antes)){1,3}\s?:\s*$", re.I)
_QUOTED_LINE = re.compile(r"^[ \t]*[>|]")
_MACHINE_LINE = re.compile(
    r"^\s*(?:(?:ERR|WARN|INFO|DEBUG|FATAL|TRACE|SELECT|INSERT|UPDATE|DELETE|at|File|Traceback|Caused by|Exception)\b.*[_./:=(].*|/[\w.\-]+/.*|[\w.\-]+ ?= ?\S+|\d{4}-\d\d-\d\d[ T]\d\d:.*|\{.*\}|\[?\w+(?:[._]\w+)+\]?.*[=:].*)$"
)
# what line wrapping left of machine text: identifiers, assignments, paths and bare keywords
_MACHINE_TOKEN = re.compile(r"\S*(?:\w_\w|[={}\\]|\w/\w|\w\.\w|^/\w)\S*|\b(?:SELECT|FROM|WHERE|ERR|WARN|DEBUG|Exception:)(?=\s|$)")


def _without_quoted_lines(text: str) -> str:
    """Without lines that begin with a reply mark; what they close beyond what they open stays closed."""
    out = []
    for line in text.split("\n"):
        if _QUOTED_LINE.match(_TAG.sub("", line)) or _QUOTED_LINE.match(line):
            tags = [m[0] for m in _QUOTE_OPEN_CLOSE.finditer(line)]
            surplus = sum(1 if "/" in t[:2] else -1 for t in tags)
            line = "[/quote]" * max(0, surplus)
        out.append(line)
    return "\n".join(out)


def _without_quotes(text: str) -> str:
    """Without bracketed quotes, nested ones included.  Where a shortened quote lost closing tags, the last one closes all."""
    tags = list(_QUOTE_OPEN_CLOSE.finditer(text))
    closing = [bool(m[1] or m[2]) for m in tags]
    short = closing.count(False) > closing.count(True)
    last = max((i for i, c in enumerate(closing) if c), default=-1)
    out, depth, at = [], 0, 0
    for i, m in enumerate(tags):
        if depth == 0:
            out.append(text[at : m.start()])
        if short and last < 0:
            # never closed: the quote ends at the first empty line
            end = text.find("\n\n", tags[-1].end())
            return "".join(out) + ("" if end < 0 else text[end:])
        depth = max(0, depth - 1) if closing[i] else depth + 1
        if short and i == last:
            depth = 0
        at = m.end()
        out.append("\n")
    if depth == 0:
        out.append(text[at:])
    return "".join(out)


def own_prose(text: str | None) -> str:
    """What the author wrote: without quoted text, signatures, pasted machine text and markup."""
    if not text:
        return ""
    text = unescape(text.replace("\r\n", "\n").replace("\r", "\n"))
    text = _SMALL.sub("\n", _BREAK.sub("\n", _CODE.sub("\n", _without_quotes(_without_quoted_lines(text)))))
    kept = []
    for line in text.split("\n"):
        bare = _TAG.sub("", line)
        if _SIGNATURE_LINE.match(bare) and kept:
            break
        if _ATTRIBUTION.match(bare) or _MACHINE_LINE.match(bare):
            continue
        kept.append(_MACHINE_TOKEN.sub(" ", bare))
    return "\n".join(kept).strip()
