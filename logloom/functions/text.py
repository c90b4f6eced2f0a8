"""Text functions of log messages, as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that masking must not touch.
PRESERVE = (
    ("http_version", r"HTTP/\d\.\d"),
    ("ip_family", r"\bIPv[46]\b"),
    ("digest_name", r"\b(?:SHA-?(?:1|224|256|384|512)|MD5|CRC32)\b"),
    ("cpu_arch", r"\b(?:x86_64|i386|i686|aarch64|ppc64(?:le)?)\b"),
    ("transport", r"\b(?:TCP|UDP|ICMP)\b"),
)
#: Masks, in the order in which they apply.
MASKS = (
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    ("iso_timestamp", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    ("clock_time", r"(?<![\w.])\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\w])", "<TIME>"),
    ("ipv6", r"(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}(?![\w:.])", "<IPV6>"),
    ("ipv4_port", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}(?![\w.])", "<IP>:<PORT>"),
    ("ipv4", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])", "<IP>"),
    ("mac_address", r"(?<![\w:])(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}(?![\w:])", "<MAC>"),
    ("hdfs_block", r"\bblk_-?\d+\b", "<BLK>"),
    ("yarn_identifier", r"\b(?:application|appattempt|container|job|task|attempt|container_e\d+)_\d+(?:_\d+)*\b", "<YARNID>"),
    ("bgl_location", r"\bR\d{2}-M\d-N[0-9A-F]-[CIJ]:(?:J\d{2}-U\d{2}|[A-Z0-9-]+)\b", "<NODE>"),
    ("bgl_node", r"\b(?:R\d{2}-M\d-N[0-9A-F]|c[0-9]+-[0-9]+c[0-9]+s[0-9]+)\b", "<NODE>"),
    ("url", r"\b(?:https?|ftp)://[^\s\"'<>]+", "<URL>"),
    ("email", r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "<EMAIL>"),
    ("long_hex", r"(?<![\w-])(?:0x)?[0-9a-fA-F]{8,}(?![\w-])", "<HEX>"),
    ("control_char", r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", "<CTRL>"),
    ("number", r"(?<![\w.])[+-]?\d+(?:\.\d+)?(?![\w.])", "<NUM>"),
    ("residual_number", r"(?<!\w)\d+(?!\w)", "<NUM>"),
)
#: Stands for a preserved token while masks run; a message that holds it is refused.
SENTINEL = "\ue000"
MIN_DIGITS = 3
#: Decimal digits of any script, and the other characters with the value of a digit, such as superscripts.
_DIGIT = "\\p{Nd}" + "".join(chr(c) for c in range(0x110000) if chr(c).isdigit() and not chr(c).isdecimal())


def normalize(message: Column, preserve: tuple = PRESERVE, masks: tuple = MASKS) -> Column:
    """Mask a message: preserved tokens aside, masks in order, tokens back, white space to one space, trimmed.

    Character classes are Unicode-aware. Null gives null; a message with the
    sentinel raises an error.
    """
    keep = "(?U)(" + "|".join(p for _, p in preserve) + ")"
    checked = F.when(F.contains(message, F.lit(SENTINEL)), F.raise_error(F.lit("message holds the reserved code point"))).otherwise(message)
    tokens = F.regexp_extract_all(checked, F.lit(keep), F.lit(1))
    masked = F.regexp_replace(checked, keep, SENTINEL)
    for _, pattern, into in masks:
        masked = F.regexp_replace(masked, "(?U)" + pattern, into)
    parts = F.split(masked, SENTINEL, -1)
    restored = F.array_join(F.zip_with(parts, F.concat(tokens, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.regexp_replace(F.regexp_replace(restored, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")


def escape_nul(message: Column) -> Column:
    """NUL-free form: only if there is a NUL, backslashes are doubled and each NUL becomes ``\\x00``."""
    escaped = F.replace(F.replace(message, F.lit("\\"), F.lit("\\\\")), F.lit("\x00"), F.lit("\\x00"))
    return F.when(F.contains(message, F.lit("\x00")), escaped).otherwise(message)


def nul_status(message: Column) -> Column:
    return F.when(F.contains(message, F.lit("\x00")), F.lit("NUL_ESCAPED")).otherwise(F.lit("UNCHANGED"))


def unescape_nul(message: Column, status: Column) -> Column:
    """The inverse of :func:`escape_nul`; null where an escape is malformed.

    The text is cut into runs without a backslash and two- or four-character escapes, which must
    make up all of it.
    """
    piece = r"(?s)\\\\|\\x00|[^\\]+"
    pieces = F.regexp_extract_all(message, F.lit(piece), F.lit(0))
    whole = F.array_join(pieces, "") == message
    plain = F.transform(pieces, lambda p: F.when(p == "\\\\", "\\").when(p == "\\x00", "\x00").otherwise(p))
    return F.when(status == "UNCHANGED", message).when(whole, F.array_join(plain, ""))


def is_volatile(word: Column) -> Column:
    """Whether a word has at least three digits, of any script."""
    # only characters beyond ASCII are held against the long class
    rest = r"[\x00-/:-\x7F]|(?=[^\x00-\x7F])[^" + _DIGIT + "]"
    return F.length(F.regexp_replace(word, rest, "")) >= MIN_DIGITS


def template_key(message: Column) -> Column:
    """The message with each volatile word, between single spaces, as ``<V>``."""
    return F.array_join(F.transform(F.split(message, " ", -1), lambda w: F.when(is_volatile(w), F.lit("<V>")).otherwise(w)), " ")


def volatile_spans(message: Column) -> Column:
    """(start, end) of the volatile words, in code points, end exclusive."""
    words = F.split(message, " ", -1)
    state = F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda a, w: F.struct(
            (a["at"] + F.length(w) + 1).alias("at"),
            F.when(is_volatile(w), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(w)).alias("stop")))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return state["spans"]


def literal_text(message: Column) -> Column:
    """Control syntax made literal: angle-bracket tokens of models lose their special form."""
    return F.replace(F.replace(message, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def corrupt(message: Column, seed: int, share: float) -> Column:
    """The message with a share of its words, one at least, as ``[MASK]``: those of the least hash of seed, message, place and word."""
    words = F.filter(F.split(message, r"\s+", -1), lambda w: w != "")

    def chosen(w: Column) -> Column:
        n = F.least(F.size(w), F.greatest(F.lit(1), F.rint(F.size(w) * F.lit(float(share))).cast("int")))
        order = F.array_sort(F.transform(w, lambda x, i: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), message, i.cast("string"), x), 256).alias("h"), i.alias("i"))))
        return F.struct(w.alias("w"), F.transform(F.slice(order, F.lit(1), n), lambda s: s["i"]).alias("hidden"))

    def masked(z: Column) -> Column:
        return F.array_join(F.transform(z["w"], lambda x, i: F.when(F.array_contains(z["hidden"], i), F.lit("[MASK]")).otherwise(x)), " ")

    return F.when(F.size(words) > 0, F.transform(F.transform(F.array(words), chosen), masked)[0]).otherwise("")


def prompt(message: Column, seed: int, share: float) -> Column:
    """The text that asks a model to restore a message; null where there is nothing to restore."""
    clean = literal_text(message)
    return F.when(clean.rlike(r"\S"), F.concat(F.lit("Restore the log message:\n"), corrupt(clean, seed, share), F.lit("\nOriginal:\n")))


def normalize_block_id(token: Column) -> Column:
    """``blk_00042`` to ``blk_42``, ``blk_-0`` to ``blk_0``, of any length; null if it is no block id."""
    sign, digits = F.regexp_extract(token, r"^blk_(-?)0*(\d+)$", 1), F.regexp_extract(token, r"^blk_(-?)0*(\d+)$", 2)
    return F.when(digits != "", F.concat(F.lit("blk_"), F.when(digits == "0", "").otherwise(sign), digits))


def _numeric_order(form: Column) -> Column:
    """A key that orders normal forms as numbers: sign, length, digits; of negative ones the longer and larger come first."""
    digits, negative = F.regexp_extract(form, r"(\d+)$", 1), F.contains(form, F.lit("-"))
    turned = F.translate(digits, "0123456789", "9876543210")
    return F.struct(
        (~negative).alias("up"), F.when(negative, -F.length(digits)).otherwise(F.length(digits)).alias("size"), F.when(negative, turned).otherwise(digits).alias("digits"), form.alias("form")
    )


def block_tokens(message: Column) -> Column:
    """Raw block tokens, their distinct normal forms in numeric order, repeated forms, malformed tokens."""
    raw = F.regexp_extract_all(message, F.lit(r"(?<![A-Za-z0-9_])blk_[^\s,;:()\[\]]*"), F.lit(0))
    good = F.filter(raw, lambda t: t.rlike(r"^blk_-?\d+$"))
    forms = F.transform(good, normalize_block_id)
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(forms), _numeric_order)), lambda k: k["form"])
    repeated = F.filter(F.array_distinct(forms), lambda t: F.size(F.filter(forms, lambda u: u == t)) > 1)
    return F.struct(
        good.alias("raw"), ordered.alias("ids"), repeated.alias("duplicates"), F.filter(raw, lambda t: ~t.rlike(r"^blk_-?\d+$")).alias("malformed")
    )


#: What the conditions of a mask rule may not speak of.
_LABEL_WORDS = ("label", "anomaly", "anomalous", "ground_truth", "groundtruth")


def load_rules(path: str) -> tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str, str], ...]]:
    """Preserved tokens and masks of a JSON rule table ``{"preserve": [...], "masks": [...]}``, checked.

    Each rule has a ``name`` of its own, a ``pattern`` that compiles and, for masks, what stands ``into`` its place. A rule that
    speaks of labels anywhere, or an unknown field, is refused: masks must not depend on them.
    """
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    names, out = set(), []
    for part, fields in (("preserve", {"name", "pattern"}), ("masks", {"name", "pattern", "into"})):
        rules = []
        for rule in table[part]:
            if set(rule) != fields:
                raise ValueError(f"a rule of {part} has the fields {sorted(rule)}")
            if any(word in str(v).lower() for v in rule.values() for word in _LABEL_WORDS):
                raise ValueError(f"rule {rule['name']} depends on labels")
            if rule["name"] in names:
                raise ValueError(f"rule {rule['name']} is there twice")
            re.compile(rule["pattern"])
            names.add(rule["name"])
            rules.append(tuple(rule[k] for k in ("name", "pattern", "into") if k in rule))
        out.append(tuple(rules))
    if set(table) - {"preserve", "masks"}:
        raise ValueError("a rule table has preserve and masks only")
    return out[0], out[1]


def json_keys(document: Column) -> Column:
    """Lower-cased distinct keys of a JSON document, at any depth, sorted; null for a null or malformed one.

    Strings are read from left to right, so what stands in a value is no key; a key is a string before a colon.
    """
    strings = F.regexp_extract_all(document, F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'), F.lit(0))
    keys = F.transform(F.filter(strings, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.lower(F.get_json_object(F.concat(F.lit('{"k":'), F.rtrim(F.substring(s, F.lit(1), F.length(s) - 1)), F.lit("}")), "$.k")))
    return F.when(F.try_parse_json(document).isNotNull(), F.array_sort(F.array_distinct(keys)))
