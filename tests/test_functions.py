"""Column functions on hand-made rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import arrays as A
from assay.functions import fixed_values as V
from assay.functions import textmetrics as TM
from assay.functions.chat import build_chat, extract_response, render_prompt
from assay.functions.text import (
    blind_order,
    decode_pred,
    encode_pred,
    media_path,
    model_short_name,
    parse_pair,
    rewrite_path,
    route,
    slice_identifier,
    strip,
    tokenizer_route,
    unblind,
)
from assay.session import local_rows


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else row


def texts(spark, values):
    return local_rows(spark, [(i, v) for i, v in enumerate(values)], "i int, t string")


def results(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_path_functions(spark):
    df = texts(spark, ["en_1234.cha", "abc", "", None])
    assert results(df, slice_identifier("t")) == ["1234", "", "", None]
    assert results(df, media_path("a/", "t", ".wav"))[2:] == ["a/.wav", None]
    moved = rewrite_path(F.lit("mp4/clips_mp4/x.mp4"), [("clips", "audio"), ("mp4", "wav")])
    assert one(spark, x=moved) == "wav/audio_wav/x.wav"


def test_strip_removes_unicode_space_only_at_the_ends(spark):
    df = texts(spark, ["  a b \n", "\x1c　", "x"])
    assert results(df, strip("t")) == ["a b", "", "x"]


def test_prediction_round_trip(spark):
    df = texts(spark, ["Yes", "two\nlines", "", " padded ", 'has """ inside'])
    assert results(df, encode_pred("t"))[1] == '"""two[NEW_LINE]lines"""'
    assert results(df, decode_pred(encode_pred("t"))) == ["Yes", "two[NEW_LINE]lines", "", "padded", "has  inside"]


def test_routes(spark):
    def handler(m_type, name, rules):
        return one(spark, x=route(F.lit(m_type), model_short_name(F.lit(name)), rules))

    for rules, both in ((V.CLASSIFICATION_ROUTES, "via"), (V.GENERATION_ROUTES, "ultravox")):
        assert handler("e2e", "Org/Qwen2-Audio", rules) == "qwen2"
        assert handler("e2e", "Org/Qwen-Audio", rules) == "qwen"
        assert handler("e2e", "via-ultravox", rules) == both
        assert handler("pipe", "Org/Qwen1.5-7B", rules) == "pipeline"
        assert handler("pipe", "Org/Qwen-7B", rules) == "pipeline_qwen"
        assert handler("e2e", "something", rules) == "pipeline"
    assert one(spark, x=tokenizer_route(F.lit("Org/Unknown"))) is None
    assert one(spark, x=tokenizer_route(F.lit("salmonn_7b"))) == "vicuna"


def test_pairs(spark):
    pair = one(spark, x=parse_pair(F.lit("en_zh-CN")))
    assert tuple(pair) == ("en", "zh-CN", "zh", "English", "Simplified Chinese")
    assert one(spark, x=parse_pair(F.lit("en_xx")))["target_name"] is None


def test_chat_and_prompts(spark):
    chat = build_chat(F.lit("S"), F.lit("U"), F.lit("mistral-7b"))
    assert [tuple(t) for t in one(spark, x=chat)] == [("user", "S\n\nU")]
    chat = build_chat(F.lit("S"), F.lit("U"), F.lit("llama"), empty_reply=True)
    assert [tuple(t) for t in one(spark, x=chat)] == [("system", "S"), ("user", "U"), ("assistant", "")]
    assert one(spark, x=render_prompt("a {} b {}", F.lit(1), F.lit("{}"))) == "a 1 b {}"
    with pytest.raises(ValueError):
        render_prompt("{} {}", F.lit(1))


def test_response_after_last_marker(spark):
    raw = "q[/INST] first [/INST]\n answer "
    assert one(spark, x=extract_response(F.lit(raw), "instruct")) == "answer"
    assert one(spark, x=extract_response(F.lit("no marker "), "instruct")) == "no marker"
    raw = "x<|im_start|>assistant says<|im_end|>"
    assert one(spark, x=extract_response(F.lit(raw), "qwen")) == "assistant says"



def test_blind_order_is_a_reproducible_permutation(spark):
    models = ["a", "b", "c"]
    rows = spark.range(300).select(blind_order("id", models).alias("o"), unblind(blind_order("id", models), F.lit(1)).alias("second")).collect()
    assert all(sorted(r["o"]) == models and r["o"][1] == r["second"] for r in rows)
    assert len({tuple(r["o"]) for r in rows}) == 6


# ---- arrays ----------------------------------------------------------------------------------------------------


def nums(*values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def test_normalising(spark):
    row = one(spark, p=A.peak_normalize(nums(1, -4, 2)), z=A.peak_normalize(nums(0, 0)), l=A.l2_normalize(nums(3, 4)), n=A.l2_normalize(nums(0, 0)))
    assert row["p"] == [0.25, -1.0, 0.5] and row["z"] is None
    assert row["l"] == pytest.approx([0.6, 0.8]) and row["n"] == [0.0, 0.0]


def test_frames(spark):
    ten = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i)
    framed = one(spark, x=A.frames(ten, 3, 2))
    assert framed == [[0, 1, 2], [2, 3, 4], [4, 5, 6], [6, 7, 8]]
    assert one(spark, x=A.frames(ten, 11, 2)) == []
    # round() takes halves to the even number: 1500 * 0.33 / 30 = 16.5
    assert one(spark, x=A.frame_size(F.lit(1500), 0.33)) == round(1500 * 0.33 / 30)
    assert one(spark, x=A.frame_size(F.lit(150), 0.5)) == 2


def test_masks_padding_channels(spark):
    mask = F.array(*[F.lit(v) for v in (True, True, True, False, True, True, False)])
    assert one(spark, x=A.chunk_all(mask, 3)) == [True, False, True]
    assert one(spark, x=A.chunk_all(mask, 8)) is None
    assert one(spark, x=A.pad_to(nums(1), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, x=A.pad_to(nums(1, 2), 1)) == [1.0, 2.0]
    assert one(spark, x=A.first_channel(F.array(nums(1, 2), nums(3, 4)))) == [1.0, 3.0]
    assert one(spark, x=A.clip_length(nums(*range(70)), 2)) == [float(v) for v in range(60)]


def test_softmax_and_draw(spark):
    probs = one(spark, x=A.softmax(nums(1, 2, 3), 0.5))
    want = [math.exp(2 * v) for v in (1, 2, 3)]
    assert probs == pytest.approx([w / sum(want) for w in want]) and sum(probs) == pytest.approx(1.0)
    for u, index in ((0.0, 0), (0.2, 0), (0.21, 1), (0.7, 1), (0.99, 2)):
        assert one(spark, x=A.draw(nums(0.2, 0.5, 0.3), F.lit(u))) == index
    assert one(spark, x=A.draw(nums(0.2, 0.2), F.lit(0.9))) == 1


# ---- text metrics ----------------------------------------------------------------------------------------------


def bleu(hyp, ref):
    """Plain Python BLEU of two token lists, written from its definition."""
    logs, k = [], 1.0
    hits = []
    for n in range(1, 5):
        h = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
        r = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
        hits.append(sum((h & r).values()))
    if not any(hits):
        return 0.0
    for n in range(1, 5):
        total = max(len(hyp) - n + 1, 0)
        if total == 0:
            return 0.0
        if hits[n - 1] == 0:
            k *= 2
            logs.append(math.log(100.0 / (k * total)))
        else:
            logs.append(math.log(100.0 * hits[n - 1] / total))
    brevity = 1.0 if len(hyp) >= len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(sum(logs) / 4)


def test_bleu_against_definition(spark):
    random.seed(3)
    pairs = [("", ""), ("", "a b c d"), ("a", "a"), ("a b c", "a b c"), ("a b c d", "a b c d"), ("x y z w", "a b c d"),
             ("a a a a a", "a a b b"), ("a b x c d", "a b c d"), ("a b", "")]
    for _ in range(60):
        words = "abcde"[: random.randint(1, 5)]
        pairs.append(tuple(" ".join(random.choice(words) for _ in range(random.randint(0, 12))) for _ in "hr"))
    df = local_rows(spark, [(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, h string, r string")
    got = results(df, TM.sentence_bleu("h", "r"))
    assert got == pytest.approx([bleu(h.split(), r.split()) for h, r in pairs], abs=1e-9)


def test_bleu_tokens_are_those_of_the_rules(spark):
    """Closed form against the rules one after the other: the same tokens get the same hashes, in the same number."""
    random.seed(5)
    chars = [".", ",", "-", "1", "2", "a", "b", " ", "\n", "\u3000", "\u2003", "你", "。", "é", "𝕏", "$", "'", "/"]
    texts = ["", ".", "..5", "5.", ".5", "5..", "a..5", "1.,2", "1-2-3", "--1-", "-", "&amp;.5", "5.你", "你.5", "😀.,.1", "1,000.5-", "a" * 400]
    texts += ["".join(random.choices(chars, k=random.randint(1, 14))) for _ in range(3000)]
    df = local_rows(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string")
    for code, tokens in (("zh", TM.tokenize_zh("t")), ("en", TM.tokenize_13a("t"))):
        rows = df.select("i", tokens.alias("tokens"), TM.bleu_text("t", code).alias("text")).orderBy("i").toArrow()
        hashes, ends = TM.token_hashes(rows["text"].combine_chunks(), np.full(len(texts), code == "zh"))
        want = rows["tokens"].to_pylist()
        assert np.diff(ends).tolist() == [len(t) for t in want]
        flat = [t for row in want for t in row]
        seen = dict(zip(flat, hashes.tolist()))
        assert [seen[t] for t in flat] == hashes.tolist() and len(set(seen.values())) == len(seen)


def test_bleu_by_hand(spark):
    # 1-grams 4/5, 2-grams 2/4, 3-grams 0/3 -> 1/(2*3), 4-grams 0/2 -> 1/(4*2); no brevity penalty.
    want = math.exp(sum(math.log(p) for p in (80.0, 50.0, 100 / 6, 100 / 8)) / 4)
    assert one(spark, x=TM.sentence_bleu(F.lit("a b x c d"), F.lit("a b c d"))) == pytest.approx(want)
    assert one(spark, x=TM.sentence_bleu(F.lit("same words all along"), F.lit("same words all along"))) == pytest.approx(100.0)
    assert one(spark, x=TM.sentence_bleu(F.lit(None).cast("string"), F.lit("a"))) is None
    with pytest.raises(ValueError):
        TM.sentence_bleu("h", "r", "ja")


def test_bleu_by_pair(spark):
    df = local_rows(spark, [(0, "en_zh-CN"), (1, "en_de")], "i int, pair string")
    # Two characters are two Chinese tokens but one 13a token.
    scores = results(df, TM.pair_bleu(F.lit("我说你好吗"), F.lit("我说你好吗"), "pair"))
    assert scores == pytest.approx([100.0, 0.0])
    with pytest.raises(Exception, match="Japanese"):
        spark.range(1).select(TM.pair_bleu(F.lit("a"), F.lit("a"), F.lit("en_ja"))).collect()


def test_tokenizers(spark):
    cases = {
        "Hello, world!": "Hello , world !",
        "1,000.5 and 3.14": "1,000.5 and 3.14",
        "a.b,c": "a . b , c",
        "year 1990-91": "year 1990 - 91",
        "&quot;x&amp;y&quot;": '" x & y "',
        "soft-\nhyphen line\nbreak": "softhyphen line break",
        "end.": "end .",
        "": "",
    }
    df = texts(spark, list(cases))
    assert results(df, F.array_join(TM.tokenize_13a("t"), " ")) == list(cases.values())
    assert one(spark, x=TM.tokenize_zh(F.lit("我说hello世界3.5。"))) == ["我", "说", "hello", "世", "界", "3.5", "。"]


def test_overlap_against_counter(spark):
    random.seed(5)
    rows = [(i, [random.choice("abcde") for _ in range(random.randint(0, 30))], [random.choice("cdefg") for _ in range(random.randint(0, 30))]) for i in range(80)]
    df = local_rows(spark, rows, "i int, a array<string>, b array<string>")
    want = [sum((Counter(a) & Counter(b)).values()) for _, a, b in rows]
    assert results(df, TM.multiset_overlap(F.col("a"), F.col("b"))) == want


def test_answer_scores(spark):
    refs = F.array(F.lit("the cat"), F.lit("A big, red DOG!"))
    assert one(spark, x=TM.best_over_references(refs, F.lit("a red dog."))) == pytest.approx(2 * 3 / 7)
    assert one(spark, x=TM.best_over_references(F.array().cast("array<string>"), F.lit("x"))) is None
    assert one(spark, x=TM.token_f1(F.lit("..."), F.lit(""))) == 1.0
    assert one(spark, x=TM.token_f1(F.lit("word"), F.lit(""))) == 0.0


def test_bleu_of_long_texts_in_slices(spark, monkeypatch):
    random.seed(4)
    pairs = [tuple(" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 300))) for _ in "hr") for _ in range(25)]
    import pyarrow as pa

    lists = [pa.array([p[k].split() for p in pairs] + [None], pa.list_(pa.string())) for k in (0, 1)]
    for size in (1 << 20, 100, 1):
        monkeypatch.setattr(TM, "SLICE_TOKENS", size)
        got = TM._bleu(lists[0].slice(3), lists[1].slice(3)).to_pylist()
        assert got[:-1] == pytest.approx([bleu(h.split(), r.split()) for h, r in pairs[3:]], abs=1e-9) and got[-1] is None
