"""Chat turns, prompts and model replies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.functions import fixed_values as V
from assay.functions.text import as_col, lookup, strip


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_chat(
    system: Column | str | None,
    user: Column | str,
    family: Column | str,
    empty_reply: bool = False,
    folded_system: Column | None = None,
) -> Column:
    """Turns ``system, user[, empty assistant]``; the mistral family gets one folded user turn.

    ``folded_system`` is the text folded into that single turn when it differs from ``system``.
    """
    user = as_col(user)
    if system is None:
        return F.array(turn("user", user))
    system = as_col(system)
    turns = [turn("system", system), turn("user", user)]
    if empty_reply:
        turns.append(turn("assistant", F.lit("")))
    folded = F.concat(system if folded_system is None else folded_system, F.lit("\n\n"), user)
    return F.when(as_col(family).contains("mistral"), F.array(turn("user", folded))).otherwise(F.array(*turns))


def audio_parts(audio_url: Column | str, text: Column | str | None) -> Column:
    """Typed content parts of one user turn: the audio first, then the text if any."""
    def part(kind: str, words: Column, url: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), words.cast("string").alias("text"), url.cast("string").alias("audio_url")
        )

    audio = part("audio", F.lit(None), as_col(audio_url))
    return F.array(audio) if text is None else F.array(audio, part("text", as_col(text), F.lit(None)))


def render_prompt(template: str, *values: Column) -> Column:
    """Fill each ``{}`` of a template with the next value; a null value gives a null prompt."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"template takes {len(pieces) - 1} values, got {len(values)}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def task_prompt(task: Column | str, prompts: dict[str, str] | None = None) -> Column:
    return lookup(task, prompts or V.TASK_PROMPTS)


def around_speech(prompt: Column) -> Column:
    """Wrap a prompt for a speech slot and cut it there: text left and right of the audio."""
    sides = F.split(render_prompt(V.SPEECH_WRAPPER, prompt), V.SPEECH_SLOT)
    return F.struct(F.get(sides, F.lit(0)).alias("left"), F.get(sides, F.lit(1)).alias("right"))


def extract_response(raw: Column | str, family: str) -> Column:
    """Text after the last marker of the family, stripped, without its end token."""
    marker, end_token = V.RESPONSE_MARKERS[family]
    tail = strip(F.substring_index(as_col(raw), marker, -1))
    return F.replace(tail, F.lit(end_token), F.lit("")) if end_token else tail
