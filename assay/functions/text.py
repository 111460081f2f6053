"""Column functions over strings: keys, paths, labels, log encoding, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import fixed_values as V


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def md5_uniform(key: Column | str, seed: int = V.SPLIT_SEED) -> Column:
    """Reproducible number in [0, 1) from a row's key: does not depend on partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def media_path(prefix: str, key: Column | str, ext: str) -> Column:
    """``prefix + key + ext``; a null key gives a null path."""
    return F.concat(F.lit(prefix), as_col(key).cast("string"), F.lit(ext))


def rewrite_path(path: Column | str, replacements: list[tuple[str, str]]) -> Column:
    """Apply literal replacements in order, every occurrence each."""
    out = as_col(path)
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def slice_identifier(name: Column | str, head: int = 3, tail: int = 4) -> Column:
    """Drop ``head`` leading and ``tail`` trailing characters; shorter strings give ''."""
    name = as_col(name)
    return F.substr(name, F.lit(head + 1), F.greatest(F.length(name) - F.lit(head + tail), F.lit(0)))


def join_context(sentences: Column | str, sep: str = ". ") -> Column:
    return F.array_join(as_col(sentences), sep)


def verbalize(code: Column | str, positive: str = "humor", negative: str = "not_humor") -> Column:
    """``positive`` for 1, ``negative`` for everything else, null included."""
    return F.when(as_col(code) == 1, F.lit(positive)).otherwise(F.lit(negative))


def model_short_name(model: Column | str) -> Column:
    return F.element_at(F.split(F.lower(as_col(model)), "/"), -1)


def strip(text: Column | str) -> Column:
    """Remove leading and trailing whitespace of any kind (plain ``trim`` removes spaces only)."""
    return F.btrim(as_col(text), F.lit(V.SPACES))


def encode_pred(pred: Column | str) -> Column:
    one_line = F.replace(as_col(pred), F.lit("\n"), F.lit(V.NEWLINE_MARK))
    return F.concat(F.lit(V.QUOTE), one_line, F.lit(V.QUOTE))


def decode_pred(encoded: Column | str) -> Column:
    """Drop every quote mark and strip; newline marks stay as they are."""
    return strip(F.replace(as_col(encoded), F.lit(V.QUOTE), F.lit("")))


def language_parts(pair: Column | str) -> tuple[Column, Column, Column]:
    """``en_zh-CN`` -> input code, output code, base of the output code."""
    parts = F.split(as_col(pair), "_")
    source, target = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return source, target, F.get(F.split(target, "-"), F.lit(0))


def lookup(key: Column | str, table: dict) -> Column:
    """Value of a short fixed table for a key, null where the key is unknown."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), as_col(key))


def parse_pair(pair: Column | str) -> Column:
    """Pair code -> struct of codes, base target code and full language names."""
    source, target, base = language_parts(pair)
    return F.struct(
        source.alias("source_code"),
        target.alias("target_code"),
        base.alias("base_code"),
        lookup(source, V.LANGUAGES).alias("source_name"),
        lookup(target, V.LANGUAGES).alias("target_name"),
    )


def route(m_type: Column | str, short_name: Column | str, rules=None) -> Column:
    """Handler of the first matching rule, in rule order; the default pipeline otherwise."""
    m_type, short_name = as_col(m_type), as_col(short_name)
    out = None
    for kind, present, absent, handler in rules or V.CLASSIFICATION_ROUTES:
        hit = (m_type == "e2e") if kind == "e2e" else (m_type != "e2e")
        hit = hit & short_name.contains(present)
        if absent:
            hit = hit & ~short_name.contains(absent)
        out = F.when(hit, handler) if out is None else out.when(hit, handler)
    return out.otherwise(V.DEFAULT_ROUTE)


def tokenizer_route(model: Column | str) -> Column:
    """Tokeniser family for a model name, null when no rule matches."""
    name = F.lower(as_col(model))
    out = None
    for words, family in V.TOKENIZER_ROUTES:
        hit = name.contains(words[0])
        for word in words[1:]:
            hit = hit | name.contains(word)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def fingerprint(content: Column | str) -> Column:
    """8 hex digits identifying some content, computed in the JVM (md5 prefix)."""
    return F.substring(F.md5(as_col(content).cast("binary")), 1, 8)


def progress_text(votes: Column | str, goal: int = V.VOTE_GOAL, code: str = V.COMPLETION_CODE) -> Column:
    votes = as_col(votes)
    running = F.format_string(V.PROGRESS_TEXT.replace("{}", "%s"), votes.cast("string"), F.lit(str(goal)))
    return F.when(votes >= goal, F.lit(V.COMPLETION_TEXT.format(code))).otherwise(running)


def blind_order(key: Column | str, models: list[str], seed: int = V.SPLIT_SEED) -> Column:
    """Reproducible shuffle of a short model list for one vote."""
    ranked = [
        F.struct(
            F.md5(F.concat(F.lit(f"{seed}:"), as_col(key).cast("string"), F.lit(f":{m}"))).alias("rank"),
            F.lit(m).alias("model"),
        )
        for m in models
    ]
    return F.transform(F.array_sort(F.array(*ranked)), lambda r: r["model"])


def unblind(order: Column | str, position: Column | str) -> Column:
    """Model behind the button at a 0-based position; null outside the list."""
    return F.get(as_col(order), as_col(position))
