"""Quoted text that is put before a language model: frames marked, instructions left out, fences kept closed.

All of it is column expressions, so it runs in the JVM over any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that open like a chat frame, and lines that address the model.
ROLE_LINE = r"(?im)^[ \t]*(system|question|answer|assistant|user|instruction|instructions)[ \t]*:"
INSTRUCTION_LINE = (
    r"(?i)\b(from now on|ignore (?:the |all |any |every )?(?:previous|earlier|above|prior)|end every (?:answer|reply|response)"
    r"|always (?:respond|answer|reply|end|start)|you are now|new instructions?|disregard (?:the |all |your )?(?:previous|earlier|above))\b"
)
META_CHARS = 120
_BLANK = r"[ \t\n\x0B\f\r]+"


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANK, " "))


def roles_marked(text: Column) -> Column:
    return F.regexp_replace(text, ROLE_LINE, "» $0")


def kept_lines(text: Column) -> Column:
    """The lines that don't address the model, as an array."""
    return F.filter(F.split(text, "\n"), lambda x: ~x.rlike(INSTRUCTION_LINE))


def without_instructions(text: Column) -> Column:
    """(text, dropped): the kept lines, and how many are left out."""
    kept = kept_lines(text)
    return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(F.split(text, "\n")) - F.size(kept)).alias("dropped"))


def safe_meta(value: Column, most: int = META_CHARS) -> Column:
    """A header field: one line, no angle brackets, no frame, no instruction, at most so many characters."""
    flat = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]", " ")
    marked = roles_marked(F.replace(F.replace(flat, F.lit("<"), F.lit("‹")), F.lit(">"), F.lit("›")))
    line = one_line(F.when(marked.rlike(INSTRUCTION_LINE), F.lit("[instruction-like text omitted]")).otherwise(marked))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def fenced(tag: Column, number: Column, meta: Column, text: Column, most: int) -> Column:
    """`<tag n=… meta>`, the quoted text and its closing tag; nothing in the text can close it."""
    body = F.replace(F.trim(text), F.lit("\r"), F.lit(""))
    body = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit(" …"))).otherwise(body)
    body = F.regexp_replace(body, r"<(?=/(?:event|doc|context|digest)>)", r"<\\")
    quoted = without_instructions(roles_marked(body))
    n = quoted["dropped"]
    note = F.when(n > 0, F.concat(F.lit("\n["), n.cast("string"), F.when(n > 1, F.lit(" instruction-like lines omitted]")).otherwise(F.lit(" instruction-like line omitted]")))).otherwise(F.lit(""))
    return F.concat(F.lit("<"), tag, F.lit(" n="), number.cast("string"), F.lit(" "), meta, F.lit(">\n"), quoted["text"], note, F.lit("\n</"), tag, F.lit(">\n"))
