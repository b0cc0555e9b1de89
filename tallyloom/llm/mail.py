"""The text bodies of mail messages, decoded."""

from __future__ import annotations

import base64
import binascii
import html
import re

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n|\A\r?\n")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*[ \t]*:|From ")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*((?:[^\r\n]|\r?\n[ \t])*)", re.I | re.M)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|mark|s|small|span|strong|sub|sup|u|wbr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>]*>", re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


def plain_of_html(text: str) -> str:
    """The text of an HTML body; tags that stand inside a line leave nothing, others a line break."""
    text = _HIDDEN.sub(" ", text)
    return html.unescape(_TAG.sub("\n", _INLINE.sub("", text)))


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        kept = _NOT_BASE64.sub("", body)
        kept = kept[: len(kept) - (len(kept) % 4 == 1)]
        raw = base64.b64decode(kept + "=" * (-len(kept) % 4))
    elif encoding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def text_bodies(message: str | None) -> list[str]:
    """The decoded text bodies of a message in order: plain and HTML parts, without headers and attachments.

    A message that doesn't begin with a header is one body. Missing closing boundaries, broken encodings and
    unknown charsets are read as far as they go, at any depth of nesting; null has no body.
    """
    if not message:
        return []
    if not _HEADER.match(message):
        return [message]
    found: list[str] = []
    parts = [message]
    while parts:
        part = parts.pop()
        cut = _BLANK.search(part)
        head, body = (part[: cut.start()], part[cut.end() :]) if cut else (part, "")
        fields = {m[1].lower(): m[2] for m in _FIELD.finditer(head)}
        kind = fields.get("content-type", "text/plain")
        low = kind.lower()
        if fields.get("content-disposition", "").lower().startswith("attachment"):
            continue
        if low.startswith("multipart/") and (b := _BOUNDARY.search(kind)):
            mark = "--" + (b[1] or b[2])
            pieces = re.split(rf"^{re.escape(mark)}(--)?[ \t]*\r?$\n?", body, flags=re.M)
            inner = []
            for i in range(2, len(pieces), 2):
                if pieces[i - 1]:
                    break
                inner.append(pieces[i])
            parts.extend(reversed(inner))
        elif low.startswith("text/"):
            charset = _CHARSET.search(kind)
            text = _decoded(body, fields.get("content-transfer-encoding", "").strip().lower(), charset[1] if charset else "utf-8")
            found.append(plain_of_html(text) if low.startswith("text/html") else text)
        elif low.startswith("message/"):
            parts.append(body.lstrip("\r\n"))
    return found
