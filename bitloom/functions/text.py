"""Text encoders and text rules as column expressions. ASCII rules throughout; other letters stay inside tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One punctuation mark, or a run of neither white space nor punctuation.
TOKEN = r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+"
RUN = r"[^\s!-/:-@\[-`{-~]+"
PUNCTUATION = r"^[!-/:-@\[-`{-~]$"
#: Special characters and the alphabet in the order of their codes. Fixed values.
SPECIALS = "!@#$%^&*()_+-=[]{}`~|;:'\"<>,.?/\\"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,!?-'\"();:"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def tokens(c: Column) -> Column:
    """Tokens of a text, lower-cased."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(TOKEN), F.lit(0))


def token_counts(c: Column) -> tuple[Column, Column]:
    """Numbers of tokens and of punctuation marks among them, counted without making the tokens."""
    marks = F.length(c) - F.length(F.regexp_replace(c, r"[!-/:-@\[-`{-~]+", ""))
    return F.regexp_count(c, F.lit(RUN)) + marks, marks


def word(c: Column) -> Column:
    """A token reduced to a-z and 0-9."""
    return F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "")


def words(c: Column) -> Column:
    """Alphanumeric runs of a text, lower-cased."""
    # Lower-cased after the match: the words are ASCII, where lower() is exact and cheaper than translating whole texts.
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def word_bits(idx: Column, width: int = 10000) -> Column:
    """The eight positions of a vocabulary word."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (idx * 8 + i) % width)


def special_index(ch: Column) -> Column:
    """Position in the list of special characters, -1 if it is none."""
    return F.instr(F.lit(SPECIALS), ch) - 1


def special_char(idx: Column) -> Column:
    """Inverse of special_index; unknown indices give a question mark."""
    return F.when((idx >= 0) & (idx < len(SPECIALS)), F.substring(F.lit(SPECIALS), idx.cast("int") + 1, F.lit(1))).otherwise("?")


def char_codes(c: Column) -> Column:
    """Groups of four characters as base-74 numbers, low digit first; characters outside the alphabet must be removed before."""
    chars = F.split(c, "")
    digits = F.transform(F.filter(chars, lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x) - 1)
    n = F.size(digits)
    groups = F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int"))
    one = lambda g: F.aggregate(F.reverse(F.slice(digits, g * 4 + 1, F.lit(4))), F.lit(0).cast("long"), lambda a, d: a * 74 + d)
    return F.when(n > 0, F.transform(groups, one)).otherwise(F.array().cast("array<bigint>"))


def char_decode(codes: Column) -> Column:
    """The text of base-74 numbers. Trailing letters 'a' of the last group are lost, as zero digits are not stored."""
    def digits(code: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.floor(code / F.pow(F.lit(74), k)).cast("long"))
        return F.aggregate(F.filter(each, lambda q: q > 0), F.lit(""), lambda s, q: F.concat(s, F.substring(F.lit(ALPHABET), (q % 74).cast("int") + 1, F.lit(1))))

    return F.aggregate(codes, F.lit(""), lambda s, c: F.concat(s, digits(c)))


def base64(c: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")


def unbase64(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def url_quote(c: Column) -> Column:
    """Form encoding: letters, digits and -_.~ stay, a space becomes +, other bytes lower-case escapes."""
    pairs = F.regexp_extract_all(F.lower(F.hex(c.cast("binary"))), F.lit(".."), F.lit(0))
    plain = [ch for ch in map(chr, range(33, 127)) if ch.isalnum() or ch in "-_.~"]
    table = F.create_map(*(F.lit(x) for ch in plain for x in (f"{ord(ch):02x}", ch)), F.lit("20"), F.lit("+"))
    return F.array_join(F.transform(pairs, lambda p: F.coalesce(F.try_element_at(table, p), F.concat(F.lit("%"), p))), "")


def url_unquote(c: Column) -> Column:
    return F.url_decode(c)


def piece_markers(c: Column, marker: str = "▁") -> Column:
    """Every word of a text with a marker in front."""
    return F.regexp_replace(c, r"(^|[ ]+)([^ ])", marker + "$2")


def lines(c: Column) -> Column:
    """Lines of a text without carriage returns; a final line break opens no line."""
    split = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    last = F.element_at(split, -1)
    return F.when(last == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def byte_tensor(c: Column, least: int = 128) -> Column:
    """Bytes scaled to [0, 1], each followed by a zero, padded with zeros to `least` entries."""
    pairs = F.regexp_extract_all(F.hex(c.cast("binary")), F.lit(".."), F.lit(0))
    flat = F.flatten(F.transform(pairs, lambda p: F.array(F.conv(p, 16, 10).cast("double") / 255, F.lit(0.0))))
    return F.concat(flat, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(least) - F.size(flat))))


def apply_template(prompt: Column, model_path: Column) -> Column:
    """The prompt in a chat template, where the model's path names an instruction-tuned model that uses it and the prompt has no control tokens yet."""
    path = F.lower(model_path)
    wanted = F.contains(path, F.lit("qwen")) & (F.contains(path, F.lit("instruct")) | F.contains(path, F.lit("chat_template")))
    bare = ~F.contains(prompt, F.lit("<|im_start|>"))
    return F.when(wanted & bare, F.concat(F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n"))).otherwise(prompt)
