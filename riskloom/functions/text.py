"""Financial-text normalisation as Column expressions (JVM regex, no UDF).

The patterns are written so that Java regex (Spark) and RE2 (DuckDB) read
them the same way, and they reproduce Python's Unicode-aware ``\\S`` and
``\\w``; Spark's own ``\\w`` is ASCII-only and would break accented text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# URL tokens (http..., www..., https...) up to the next Unicode whitespace
URL_PATTERN = r"(http|www)[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
# HTML tags, non-greedy, within one line
HTML_PATTERN = r"<[^\n]*?>"
# code points that are emoji by themselves (Unicode emoji data), as ranges
EMOJI_RANGES = """00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6
25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D
2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C
2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F
1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D
1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC
1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7
1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C
1FA80-1FA8A 1FA8E-1FAC6 1FAC8 1FACD-1FADC 1FADF-1FAEA 1FAEF-1FAF8"""
_EMOJI = "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in EMOJI_RANGES.split())
# keycaps, or an emoji with its variation selectors, skin tones, tags and joined emoji
EMOJI_PATTERN = (r"[0-9#*]\x{FE0F}?\x{20E3}|"
                 rf"[{_EMOJI}](?:[\x{{FE0E}}\x{{FE0F}}\x{{20E3}}\x{{1F3FB}}-\x{{1F3FF}}\x{{E0020}}-\x{{E007F}}]|\x{{200D}}[{_EMOJI}])*")
# everything except word characters and the kept financial symbols $ . € £ ¥ -
SPECIAL_PATTERN = r"[^\p{L}\p{N}_$.€£¥-]+"
TICKER_PATTERN = r"\$[A-Z]+"
UNICODE_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"

# Aspect taxonomy: the first key contained in the aspect wins, in this order.
ASPECT_MAPPING = [
    ("stock price", "price_action"),
    ("share price", "price_action"),
    ("volatility", "volatility"),
    ("trading", "trading_volume"),
    ("earnings", "earnings"),
    ("revenue", "revenue"),
    ("profit", "profitability"),
    ("loss", "profitability"),
    ("merger", "ma"),
    ("acquisition", "ma"),
    ("dividend", "dividend"),
    ("buyback", "buyback"),
    ("ipo", "ipo"),
    ("bankruptcy", "bankruptcy"),
    ("lawsuit", "legal"),
    ("regulation", "regulatory"),
    ("upgrade", "analyst_rating"),
    ("downgrade", "analyst_rating"),
    ("target price", "price_target"),
]
DIRECTION_LABELS = {"positive": 0, "neutral": 1, "negative": 2}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c) -> Column:
    return F.regexp_replace(_c(c), URL_PATTERN, "")


def strip_html(c) -> Column:
    return F.regexp_replace(_c(c), HTML_PATTERN, "")


# A position is looked at by all those ranges only where one wide range allows it.
_MAYBE_EMOJI = r"(?=[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAF8}]|[0-9#*]\x{FE0F}?\x{20E3})"


def strip_emoji(c) -> Column:
    return F.regexp_replace(_c(c), f"{_MAYBE_EMOJI}(?:{EMOJI_PATTERN})", "")


def strip_special(c) -> Column:
    return F.regexp_replace(_c(c), SPECIAL_PATTERN, " ")


def collapse_ws_lower(c) -> Column:
    """Collapse Unicode whitespace runs to one space, trim, lower-case."""
    collapsed = F.regexp_replace(_c(c), UNICODE_SPACE + "+", " ")
    return F.lower(F.trim(collapsed))


def clean_text(c, remove_emojis: bool = True) -> Column:
    """URLs, tags (and emoji) removed, other symbols to spaces, whitespace
    collapsed, lower-cased; NULL becomes ''."""
    t = strip_html(strip_urls(F.coalesce(_c(c).cast("string"), F.lit(""))))
    if remove_emojis:
        t = strip_emoji(t)
    return collapse_ws_lower(strip_special(t))


def preserve_tickers(text, source=None) -> Column:
    """Restore ``$TICKER`` tokens found in ``source`` (default: ``text``)
    wherever their lower-case form appears in ``text``."""
    src = _c(source) if source is not None else _c(text)
    tickers = F.regexp_extract_all(src, F.lit(TICKER_PATTERN), 0)
    return F.aggregate(tickers, _c(text), lambda acc, t: F.replace(acc, F.lower(t), t))


def _first_aspect(key: Column) -> Column:
    out = F.lit("other")
    for k, v in reversed(ASPECT_MAPPING):
        out = F.when(key.contains(k), F.lit(v)).otherwise(out)
    return out


def _map_aspect_expr(a: Column) -> Column:
    # only the start of a run of blanks is tried for the end of the text
    trimmed = F.regexp_replace(a, f"^{UNICODE_SPACE}++|(?<!{UNICODE_SPACE}){UNICODE_SPACE}++$", "")
    # bound as a variable, trimmed and lower-cased once; as a plain expression it would be evaluated anew for every taxonomy key
    found = F.get(F.transform(F.array(F.lower(trimmed)), _first_aspect), F.lit(0))
    return F.when(a.isNull(), F.lit("other")).otherwise(found)


def map_aspect(c) -> Column:
    return _map_aspect_expr(_c(c))


def topic_aspects(c) -> Column:
    """A list literal of topics -> list of mapped aspects; NULL -> []. A
    ``None`` item maps like a missing topic; other text than a list fails."""
    listed = F.regexp_replace(_c(c), r"(?<=[\[,])\s*None\s*(?=[\],])", "null")
    topics = F.from_json(listed, "array<string>")
    bad = F.raise_error(F.concat(F.lit("not a list of topics: "), _c(c))).cast("array<string>")
    return (F.when(_c(c).isNull(), F.array().cast("array<string>"))
            .when(topics.isNull(), bad)
            .otherwise(F.transform(topics, _map_aspect_expr)))


def direction_label(c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in DIRECTION_LABELS.items() for x in kv])
    return F.element_at(m, _c(c))


def full_text(headline, body) -> Column:
    """headline + ' ' + body; NULL when either side is NULL."""
    return F.concat(_c(headline), F.lit(" "), _c(body))
