"""Text as column expressions: sentences, negation, tense, temporal references, spans, support, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LABEL_CUES, NEGATION_CUES, NEGATION_WINDOW, NEGATION_WORDS, PERSONA_CUES, RELATION_CUES, TEMPORAL, TEMPORAL_CONFIDENCE, TENSES

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word(pattern: str) -> str:
    """The pattern between Unicode word borders, whatever the case."""
    return rf"(?iU)\b{pattern}\b"


def sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each sentence: sent_idx from 0 and sentence, beside the other columns. A part ends in a mark and the next starts with a letter, so only the ends of the text are trimmed."""
    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    parts = F.filter(F.split(trimmed, SENTENCE_END), lambda s: s != "")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("sent_idx", "sentence"))


def negated_before(sentence: Column, start: Column, end: Column) -> Column:
    """Whether a negation word stands in the window before a span (0-based) or in it. A window that cuts a word may make one up."""
    begin = F.greatest(F.lit(0), start - NEGATION_WINDOW)
    window = F.lower(sentence.substr(begin + 1, end - begin))
    found = F.regexp_extract_all(window, F.lit(r"(?U)\b\w+(?:'[tn])?\b"), F.lit(0))
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in NEGATION_WORDS]))


def affirmed(sentence: Column) -> Column:
    """False where the sentence has a negation cue."""
    return ~sentence.rlike(word("(" + "|".join(NEGATION_CUES) + ")"))


def label_negated(sentence: Column) -> Column:
    """The polarity label of training data: cues of negation, failure and doubt."""
    return sentence.rlike(word("(" + "|".join(NEGATION_CUES + LABEL_CUES) + ")"))


def tense(sentence: Column) -> Column:
    out = F.lit("present")
    for name, pattern in reversed(TENSES):
        out = F.when(sentence.rlike(word(pattern)), name).otherwise(out)
    return out


def relation_type(text: Column) -> Column:
    lower, out = F.lower(text), F.lit("none")
    for name, cues in reversed(RELATION_CUES):
        out = F.when(reduce(Column.__or__, [lower.contains(c) for c in cues]), name).otherwise(out)
    return out


def temporal_refs(sentence: Column) -> Column:
    """All matches of each pattern in turn, as (text, precision, confidence); a quarter's year is also a year."""
    found = []
    for precision, pattern in TEMPORAL:
        hits = F.regexp_extract_all(sentence, F.lit(rf"(?U)\b(?:{pattern})\b"), F.lit(0))
        found.append(F.transform(hits, _as_ref(precision)))
    return F.concat(*found)


def _as_ref(precision: str):
    return lambda t: F.struct(t.alias("text"), F.lit(precision).alias("precision"), F.lit(TEMPORAL_CONFIDENCE).alias("confidence"))


def precision(refs: Column) -> Column:
    return F.coalesce(F.get(refs, F.lit(0))["precision"], F.lit("unknown"))


def escaped(token: Column | str) -> Column:
    return F.concat(F.lit(r"\Q"), token, F.lit(r"\E"))


def first_token_span(sentence: Column, tokens: Column) -> Column:
    """(start, end) of the first token, in their order, that stands in the sentence as a word; else the whole sentence."""
    lower = F.lower(sentence)
    places = F.transform(tokens, lambda t: F.struct(F.regexp_instr(lower, F.concat(F.lit(r"(?U)\b"), escaped(F.lower(t)), F.lit(r"\b"))).alias("at"), F.length(t).alias("n")))
    first = F.get(F.filter(places, lambda p: p["at"] > 0), F.lit(0))
    return bound(first, lambda hit: F.when(hit.isNotNull(), F.struct((hit["at"] - 1).alias("start"), (hit["at"] - 1 + hit["n"]).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.length(sentence).alias("end"))))


def longest_token_span(sentence: Column, tokens: Column) -> Column:
    """(text, start, end) of the leftmost match of any token, longer ones tried first; null without any."""
    return span_of(sentence, longest_token_pattern(tokens))


def longest_token_pattern(tokens: Column) -> Column:
    """What span_of() looks for; null without tokens. Best made once for each list of tokens, not for each sentence."""
    by_length = F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: escaped(x.getField("t")))
    return F.when(F.size(tokens) > 0, F.concat(F.lit(r"(?iU)\b("), F.array_join(by_length, "|"), F.lit(r")\b")))


def span_of(sentence: Column, pattern: Column) -> Column:
    at, text = F.regexp_instr(sentence, pattern), F.call_function("regexp_extract", sentence, pattern, F.lit(1))
    span = lambda a: bound(text, lambda t: F.struct(t.alias("text"), (a - 1).alias("start"), (a - 1 + F.length(t)).alias("end")))
    return bound(at, lambda a: F.when(a > 0, span(a)))


def support(sentence: Column, tokens: Column, below: Column) -> Column:
    """direct where a token is in the sentence, hierarchical where one of a descendant is, else semantic."""
    lower = F.lower(sentence)
    has = lambda ts: F.exists(ts, lambda t: F.contains(lower, F.lower(t)))
    return F.when(has(tokens), "direct").when(has(below), "hierarchical").otherwise("semantic")


def fact_id(*parts: Column) -> Column:
    return F.concat(F.lit("inf_"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12))


def imagined_id(s: Column, p: Column, o: Column, polarity: Column) -> Column:
    return F.concat(F.lit("img_"), F.substring(F.sha2(F.concat_ws(":", F.lit("imagined"), s, p, o, polarity.cast("int").cast("string")), 256), 1, 12))


def imagined_sentence(s: Column, p: Column, o: Column, polarity: Column) -> Column:
    return F.format_string("imagined: <<%s, %s, %s; %d>>", p, s, o, polarity.cast("int"))


def sentence_id(doc: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", doc.cast("string"), index)


def persona_of_text(query: Column) -> Column:
    """The persona that the query names by a cue; null without any."""
    lower, out = F.lower(query), F.lit(None).cast("string")
    for name, cues in reversed(PERSONA_CUES):
        out = F.when(reduce(Column.__or__, [lower.contains(c) for c in cues]), name).otherwise(out)
    return out


def shortened(value: Column, most: int = 30) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 2), F.lit(".."))).otherwise(value)
