"""HTML to Markdown and HTML to plain text as chains of built-in string functions, in SQL text.

Each rule is a pattern that runs in linear time on broken markup too: tag patterns stop at the next `<`, and an
unclosed comment, script or style runs to the end of the text, as browsers treat it, and an unclosed head to the body.
"""

from __future__ import annotations

# Content that is never text. One pass, so that a comment inside a script does not count as one, nor the reverse.
DROPPED = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)"
    r"|head\b[^<>]*>.*?(?:</head\s*>|(?=<body\b)|\z))"
)
HEADING_OPEN = r"(?i)<h([1-6])\b[^<>]*>"
STRONG = r"(?i)<(?:b|strong)(?:\s[^<>]*)?>([^<]*)</(?:b|strong)\s*>"
EMPHASIS = r"(?i)<(?:i|em)(?:\s[^<>]*)?>([^<]*)</(?:i|em)\s*>"
LIST_ITEM = r"(?i)<li\b[^<>]*>"
LINE_BREAK = r"(?i)<br\b[^<>]*>"
BLOCK = (
    r"(?i)</?(?:p|div|section|article|header|footer|nav|aside|main|ul|ol|dl|dt|dd|table|tr|blockquote|pre|form"
    r"|figure|figcaption|address|fieldset|hr|h[1-6]|body|html)\b[^<>]*>"
)
NOT_A_LINK = r"(?i)</?(?:[b-z!?][^<>]*|a[a-z0-9][^<>]*)>"
LINK = r"(?i)<a\s(?=[^<>]*+>)(?>[^<>]*?href\s*=\s*[\x22\x27]?([^\x22\x27<>\s]*+)[^<>]*+>)([^<]*+)</a\s*>"
ANY_TAG = r"(?i)</?[a-z!?][^<>]*>"
BLANKS = r"[ \t\r\f]+"
BLANK_AROUND_BREAK = r" ?\n ?"
BREAKS = r"\n{3,}"
ANY_SPACE = r"\s+"

# Named entities; the ampersand comes last so that `&amp;lt;` stays `&lt;`.
ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&copy;": "©",
    "&reg;": "®",
    "&trade;": "™",
    "&middot;": "·",
    "&bull;": "•",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&laquo;": "«",
    "&raquo;": "»",
    "&lsquo;": "‘",
    "&rsquo;": "’",
    "&ldquo;": "“",
    "&rdquo;": "”",
    "&euro;": "€",
    "&amp;": "&",
}


def _apply(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, r'{pattern}', '{replacement}')"
    return text


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _replace(text: str, replacements: dict[str, str]) -> str:
    for old, new in replacements.items():
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    return text


def unescape(text: str) -> str:
    return _replace(text, ENTITIES)


def _strip(text: str) -> str:
    return f"btrim({text}, ' \t\r\n')"


def html_to_markdown(html: str) -> str:
    text = _apply(html, [(DROPPED, ""), (HEADING_OPEN, "\n\n<h$1>")])
    text = _replace(text, {f"<h{level}>": "#" * level + " " for level in range(1, 7)})
    text = _apply(
        text,
        [
            (STRONG, "**$1**"),
            (EMPHASIS, "*$1*"),
            (LIST_ITEM, "\n- "),
            (LINE_BREAK, "\n"),
            (BLOCK, "\n\n"),
            (NOT_A_LINK, ""),
            (LINK, "[$2]($1)"),
            (ANY_TAG, ""),
            (BLANKS, " "),
            (BLANK_AROUND_BREAK, "\n"),
            (BREAKS, "\n\n"),
        ],
    )
    return _strip(unescape(text))


def html_to_text(html: str) -> str:
    return _strip(_apply(unescape(_apply(html, [(DROPPED, ""), (ANY_TAG, " ")])), [(ANY_SPACE, " ")]))


def decode_text(content: str) -> str:
    """Bytes as UTF-8 text; bad sequences become U+FFFD, which scoring then penalises."""
    return f"make_valid_utf8(cast({content} AS string))"
