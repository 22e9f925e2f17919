"""What a raw mail reads like: its text parts with transfer encoding, charset and markup undone."""

from __future__ import annotations

import binascii
import html
import re
import zlib
from collections.abc import Iterator

HEAD_END = re.compile(r"\r?\n[ \t]*\r?\n")
FOLD = re.compile(r"\r?\n[ \t]+")
FIELD = re.compile(r"(?im)^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*([^\r\n]*)")
PARAMETER = re.compile(r"""(?i)\b(boundary|charset|format)[ \t]*=[ \t]*(?:"([^"]*)"|([^\s;"]+))""")
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
#: UTF-8 that was read as Windows-1252 or Latin-1: a lead character of Western European text, punctuation or emoji, and
#: what its continuation bytes turn into.
MISREAD = re.compile(
    "[ÂÃÅâïð]"
    "[\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013\u2014\u2018-\u201a\u201c-\u201e\u2020-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]{1,3}"
)
UNSEEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(style|script|head|title)\b.*?(?:</\1\s*>|\Z)")
BREAK = re.compile(r"(?i)</?(?:p|div|br|tr|td|th|li|ul|ol|table|blockquote|h[1-6]|hr|body|html|pre)\b[^>]*>")
TAG = re.compile(r"</?[A-Za-z][^>]*>")
#: Invisible characters: soft hyphen, joiners, zero-width characters, direction marks, variation selectors, byte order mark.
INVISIBLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e"
    "\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]"
)
WORD = re.compile(r"[^\W_]+")


def _reread(match: re.Match) -> str:
    run = match.group()
    raw = bytearray()
    for char in run:
        try:
            raw += char.encode("latin-1") if ord(char) < 256 else char.encode("cp1252")
        except UnicodeEncodeError:
            return run
    for end in range(len(raw), 1, -1):
        try:
            return raw[:end].decode("utf-8") + run[end:]
        except UnicodeDecodeError:
            continue
    return run


def _from_bytes(raw: bytes, charset: str) -> str:
    """Bytes that are valid UTF-8 are read so, whatever is declared; else the declared charset or Windows-1252."""
    for name in ("utf-8", charset if charset not in ("", "utf-8", "us-ascii", "ascii") else "cp1252", "cp1252"):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


def decoded(body: str, encoding: str, charset: str) -> str:
    """The body of a part, without its transfer encoding and with misread characters put right."""
    if encoding == "base64":
        digits = NOT_BASE64.sub("", body.split("=", 1)[0] if "=" in body[:-4] else body)
        digits = digits[: len(digits) - (len(digits) % 4 == 1)]
        body = _from_bytes(binascii.a2b_base64(digits + "=" * (-len(digits) % 4)), charset)
    elif encoding == "quoted-printable":
        body = _from_bytes(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), charset)
    return body if body.isascii() else MISREAD.sub(_reread, body)


def without_markup(body: str, line: str = "\n") -> str:
    """HTML as it reads: unseen elements dropped, block elements as line breaks, inline tags as nothing."""
    return html.unescape(TAG.sub("", BREAK.sub(line, UNSEEN.sub("", body))))


def _between(body: str, boundary: str) -> list[str]:
    """What stands after each opening boundary line, up to the next boundary line or the end."""
    found, inside, line = [], False, "\n--" + boundary
    at, start = ("\n" + body).find(line), 0
    text = "\n" + body
    while at >= 0:
        after = at + len(line)
        end = text.find("\n", after)
        rest = text[after : end if end >= 0 else len(text)].strip()
        if rest in ("", "--"):  # a longer boundary that begins alike is another part's
            if inside:
                found.append(text[start:at])
            inside, start = rest == "", (end + 1 if end >= 0 else len(text))
        at = text.find(line, after)
    return found + [text[start:]] * inside


def parts(raw: str, depth: int = 0) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, body, parameters) of each text part; kind is plain, html or attached. Other parts are passed over.

    Takes what broken mails hold: missing headers, parts that are not closed, unknown charsets, cut-off encodings.
    """
    at = HEAD_END.search(raw)
    head, body = (raw[: at.start()], raw[at.end() :]) if at else (raw, "")
    if raw[:1] in "\r\n":
        head, body = "", raw
    fields = {k.lower(): v for k, v in FIELD.findall(FOLD.sub(" ", head))}
    kind = fields.get("content-type", "text/plain")
    given = {k.lower(): a or b for k, a, b in PARAMETER.findall(kind)}
    kind = kind.split(";", 1)[0].strip().lower()
    if kind.startswith("multipart/") and given.get("boundary") and depth < 20:
        inner = _between(body, given["boundary"])
        for part in inner:
            yield from parts(part, depth + 1)
        if inner:
            return
    elif kind == "message/rfc822" and depth < 20:
        yield from parts(body.lstrip("\r\n"), depth + 1)
        return
    if kind.startswith(("text/", "multipart/")) or "/" not in kind:
        attached = fields.get("content-disposition", "").lower().startswith("attachment")
        body = decoded(body, fields.get("content-transfer-encoding", "").strip().lower(), given.get("charset", "").lower())
        yield ("attached" if attached else "html" if kind == "text/html" else "plain"), (body if kind != "text/html" or not attached else without_markup(body)), given


def readable_parts(raw: str | None) -> list[str]:
    """The text parts of a mail (text attachments included) as they read; none for null or empty."""
    return [without_markup(body) if kind == "html" else body for kind, body, _ in parts(raw)] if raw else []


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case, without invisible characters."""
    return WORD.findall((text if text.isascii() else INVISIBLE.sub("", text)).lower())


QUOTE_MARK = re.compile(r"(?m)^[ \t]*(?:[>|:}][ \t]?)+")
BLANK_LINE = re.compile(r"\n\s*\n")
#: How mail programs introduce a quoted or forwarded mail (English, German, Spanish).
INTRODUCTION = re.compile(
    r"\n(?:On [^\n]{0,160}(?:\n[^\n]{0,120})?\swrote:|Am [^\n]{0,160}(?:\n[^\n]{0,120})?schrieb\s[^\n:]{1,120}:"
    r"|El [^\n]{0,160}(?:\n[^\n]{0,120})?\sescribi[óo]:|[-_]{4,}[^\n]*"
    r"|(?:From|Sent|To|Cc|Subject|Date|Von|Gesendet|An|Betreff|Datum|De|Enviado|Para|Asunto|Fecha):[^\n]*)[ \t]*(?=\n)"
)
#: A line of its own that only says whose words follow: a name of two or three words, a dash, and when that was.
NAME_AND_DATE = re.compile(r"[^\n.?!]{3,60} - [^\n]{0,40}\d[^\n]{0,40}\Z|(?:[A-ZÀ-Ý][\w'-]+ ){2,3}- [^\n.?!]{3,40}\Z")
SIGNATURE = re.compile(r"\n(?:--|__)[ \t]*\n(?:[^\n]*\S[^\n]*\n)*")
HTML_SIGNATURE = re.compile(r"""(?s)<(p|div)\b[^>]*class=["']?sig(?:nature)?\b.*?(?:</\1>|\Z)""")
#: Phrases by which a paragraph may be a disclaimer or a notice of a list or mail program (English, German, Spanish), in lower case. It
#: is one only if the archive bears it out: see ``notice_marks``.
NOTICES = (
    "confidential:", "meant only for the addressee", "joined a list run by", "before printing this mail", "reader cannot show this",
    "vertraulich.", "ist nur für die empf", "irrläufer", "vor dem drucken", "confidencial.", "solo para su destinatari", "antes de imprimir",
)
#: A notice has no more words than this.
LONGEST_NOTICE = 60
#: Marks are numbers below this, so there are no more of them.
MARKS = 1 << 20
SENTENCE_END = re.compile(r"(?<=[.?!:])\s+")


def notice_marks(low: str) -> tuple[int, int]:
    """Two marks of a paragraph that may be a notice: of the four words from a notice's phrase on, and of its last four; else (0, 0).

    Notices come from a pattern, so many senders have the same words there, whatever names and numbers stand between. A paragraph
    that merely has such a phrase shares them with nobody.
    """
    for notice in NOTICES:
        if (at := low.find(notice)) >= 0:
            own = WORD.findall(low)
            if len(own) <= LONGEST_NOTICE:
                of = (WORD.findall(low[at:])[:4], own[-4:])
                return tuple(1 + zlib.crc32(" ".join(w).encode("utf-8", "replace")) % (MARKS - 1) for w in of)
    return (0, 0)


def running_sentences(raw: str | None) -> list[tuple[list[str], tuple[int, int]]]:
    """The words of each sentence of a mail's running text, every paragraph once, with the ``notice_marks`` of its paragraph.

    Running text is the writer's own paragraphs and the quoted ones. Headers, quote introductions, signatures and
    attachments are left out; so are, later, the paragraphs whose marks many senders share. Of several parts that hold the same
    paragraph, one counts.
    """
    found: dict[str, list[tuple[list[str], tuple[int, int]]]] = {}
    for kind, body, _ in parts(raw) if raw else ():
        if kind == "attached":
            continue
        if kind == "html":
            body = HTML_SIGNATURE.sub("", body).replace("\r", " ").replace("\n", " ").replace("<br>", "\n")
            body = without_markup(body, "\n\n")
        body = "\n" + QUOTE_MARK.sub("", body.replace("\r", "")) + "\n"
        body = SIGNATURE.sub("\n\n", INTRODUCTION.sub("\n\n", body))
        for paragraph in BLANK_LINE.split(body):
            if not (paragraph := paragraph.strip()) or NAME_AND_DATE.match(paragraph):
                continue
            low = (paragraph if paragraph.isascii() else INVISIBLE.sub("", paragraph)).lower()
            marks = notice_marks(low)
            sentences = [(w, marks) for s in SENTENCE_END.split(low) if (w := WORD.findall(s))]
            found.setdefault(" ".join([" ".join(s) for s, _ in sentences]), sentences)
    return [s for sentences in found.values() for s in sentences]
