"""They must equal the published evaluation set-up for results to agree."""

# Field separator, newline stand-in, quote and failure text of a result log line (fixed values).
FIELD_SEP = "[SEP_DIAL]"
NEWLINE_MARK = "[NEW_LINE]"
QUOTE = '"""'
ERROR_TEXT = "ERROR IN PROCESSING"
MISSING_SCORE = "NA"

# Missing-value spellings a delimited table may carry (pandas' documented defaults).
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Python's str.isspace() set as a character class; Java and RE2 both read \x{...}.
SPACE_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same characters as one string, for trimming.
SPACES = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ASCII punctuation, as in string.punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Characters the Chinese BLEU tokeniser isolates (public sacrebleu ranges as they take effect).
CJK_CLASS = (
    r"[\x{2001}-\x{2a6d}\x{2e80}-\x{2fdf}\x{2ff0}-\x{303f}\x{3100}-\x{312f}\x{31a0}-\x{31bf}"
    r"\x{31c0}-\x{31ef}\x{3200}-\x{4db5}\x{4e00}-\x{9fbb}\x{f900}-\x{fa2d}\x{fa30}-\x{fa6a}"
    r"\x{fa70}-\x{fad9}\x{fe10}-\x{fe1f}\x{fe30}-\x{fe4f}\x{ff00}-\x{ffef}]"
)

# Spoken-intent codes 0..100, in code order (fixed values).
INTENTS = [
    "addcontact", "alarm_query", "alarm_remove", "alarm_set", "audio_volume_down",
    "audio_volume_mute", "audio_volume_other", "audio_volume_up", "calendar_query",
    "calendar_remove", "calendar_set", "cleaning", "coffee", "convert", "cooking_query",
    "cooking_recipe", "createoradd", "currency", "datetime_convert", "datetime_query",
    "definition", "email_addcontact", "email_query", "email_querycontact", "email_sendemail",
    "events", "factoid", "game", "general_affirm", "general_commandstop", "general_confirm",
    "general_dontcare", "general_explain", "general_greet", "general_joke", "general_negate",
    "general_praise", "general_quirky", "general_repeat", "greet", "hue_lightdim",
    "hue_lightoff", "hue_lightup", "iot_cleaning", "iot_coffee", "iot_hue_lightchange",
    "iot_hue_lightdim", "iot_hue_lightoff", "iot_hue_lighton", "iot_hue_lightup",
    "iot_wemo_off", "iot_wemo_on", "joke", "likeness", "lists_createoradd", "lists_query",
    "lists_remove", "locations", "music", "music_dislikeness", "music_likeness",
    "music_query", "music_settings", "news_query", "play_audiobook", "play_game",
    "play_music", "play_podcasts", "play_radio", "podcasts", "post", "qa_currency",
    "qa_definition", "qa_factoid", "qa_maths", "qa_stock", "query", "querycontact", "quirky",
    "radio", "recommendation_events", "recommendation_locations", "recommendation_movies",
    "remove", "sendemail", "set", "settings", "social_post", "social_query",
    "takeaway_order", "takeaway_query", "ticket", "traffic", "transport_query",
    "transport_taxi", "transport_ticket", "transport_traffic", "volume_other",
    "weather_query", "wemo_off", "wemo_on",
]

# Emotion codes of the two emotion sets, in code order (fixed values).
EMOTIONS_4 = ["angry", "happy", "neutral", "sad"]
EMOTIONS_7 = ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"]

# Language codes of the translation pairs (fixed values).
LANGUAGES = {
    "en": "English",
    "de": "German",
    "tr": "Turkish",
    "fa": "Persian",
    "sv-SE": "Swedish",
    "mn": "Mongolian",
    "zh-CN": "Simplified Chinese",
    "cy": "Welsh",
    "ca": "Catalan",
    "sl": "Slovenian",
    "et": "Estonian",
    "id": "Indonesian",
    "ar": "Arabic",
    "ta": "Tamil",
    "lv": "Latvian",
    "ja": "Japanese",
}

# Dialect columns of the spoken question set, in evaluation order (fixed values).
DIALECTS = ["usa", "aus", "gbr", "ind_n", "ind_s", "irl", "kenya", "nga", "nzl", "phl", "zaf"]

# Active translation pairs, in evaluation order (fixed values).
TRANSLATION_PAIRS = ["en_zh-CN", "en_id", "en_ar", "en_ta", "en_ja"]

# Answer label -> target value per classification task, in label order (fixed values).
LABEL_MAPS = {
    "Mustard_sarcasm": {"Yes": "true", "No": "false"},
    "MELD_emotion_recognition": {
        "Anger": "anger",
        "Disgust": "disgust",
        "Fear": "fear",
        "Joy": "joy",
        "Neutral": "neutral",
        "Sadness": "sadness",
        "Surprise": "surprise",
    },
    "URFunny_humor": {"Yes": "humor", "No": "not_humor"},
    "Callhome_relationships": {"Family": "RELATIVE", "Friends": "FRIEND"},
    "IEMOCAP_emotion_recognition": {
        "Anger": "angry",
        "Happiness": "happy",
        "Neutral": "neutral",
        "Sadness": "sad",
    },
}

# Task prompts used when predicting (fixed values).
TASK_PROMPTS = {
    "Mustard_sarcasm":
        "Respond whether the input is sarcastic. Answer with a simple yes or no.",
    "MELD_emotion_recognition":
        "Respond in a single word what emotion the input exhibits.\nIf there is no clear emotion, respond 'Neutral'.",
    "URFunny_humor":
        "Respond whether the input is intended to be humorous. Answer with a simple yes or no.",
    "Callhome_relationships":
        "Respond whether the people talking are family or friends. Respond simply 'Family' or 'Friends'.",
    "IEMOCAP_emotion_recognition":
        "Respond in a single word what emotion the audio represents.\nIf there is no clear emotion, respond 'Neutral'.",
}

# The metric job words the same tasks differently (fixed values).
METRIC_PROMPTS = {
    "Mustard_sarcasm":
        "Does the tone or content of the previous statement indicate sarcasm?",
    "MELD_emotion_recognition":
        "What emotion does the previous statement communicate?\nIf there is no clear emotion, respond 'Neutral'.",
    "URFunny_humor":
        "Is the final sentence of the previous passage a punchline to a joke?",
    "Callhome_relationships":
        "Are the people speaking family or friends?",
    "IEMOCAP_emotion_recognition":
        "What emotion does the previous statement communicate?\nIf there is no clear emotion, respond 'Neutral'.",
}

# System texts and wrappers around a prompt (fixed values). {} marks the inserted text.
ASSISTANT = "You are a helpful assistant."
QA_SYSTEM = "You are a helpful assistant. Give answers as a simple single sentence."
QA_SUFFIX = " Give a simple one sentence answer."
TRANSLATE_SYSTEM = "You are a helpful assistant. Translate the inputs from {} to {}."
TRANSLATE_USER = "Translate the input from {} to {}."
TRANSLATE_SUFFIX = ". Translate the inputs from {} to {}."
SPEECH_WRAPPER = "USER: <Speech><SpeechHere></Speech> {}\nASSISTANT:"
SPEECH_SLOT = "<SpeechHere>"
HUMAN_WRAPPER = "###[Human]:{}"
REPLY_WRAPPER = "\n\n\n###[Assistant]:"

# Marker after which a model family's reply starts, and the end token removed from it (fixed values).
RESPONSE_MARKERS = {
    "llama3": ("<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"),
    "instruct": ("[/INST]", ""),
    "qwen": ("<|im_start|>", "<|im_end|>"),
}

# Handler rules in test order: (run type, must contain, must not contain, handler) (fixed values).
# Run type "e2e" matches exactly; "other" matches every different type.
CLASSIFICATION_ROUTES = [
    ("e2e", "qwen2", None, "qwen2"),
    ("e2e", "qwen", None, "qwen"),
    ("e2e", "salmonn", None, "salmonn"),
    ("e2e", "blsp", None, "blsp"),
    ("e2e", "via", None, "via"),
    ("e2e", "ultravox", None, "ultravox"),
    ("other", "qwen", "1.5", "pipeline_qwen"),
]
GENERATION_ROUTES = [
    ("e2e", "qwen2", None, "qwen2"),
    ("e2e", "qwen", None, "qwen"),
    ("e2e", "salmonn", None, "salmonn"),
    ("e2e", "blsp", None, "blsp"),
    ("e2e", "ultravox", None, "ultravox"),
    ("e2e", "via", None, "via"),
    ("other", "qwen", "1.5", "pipeline_qwen"),
]
DEFAULT_ROUTE = "pipeline"

# Tokeniser chosen by the metric job: any of the substrings of the lower-cased model name (fixed values).
TOKENIZER_ROUTES = [(("via", "llama"), "llama"), (("salmonn",), "vicuna"), (("qwen",), "qwen")]

# Evaluation sets: name -> (input column, target column, split, decode list or None) (fixed values).
# The dialect set names its input column after the requested language.
EVAL_SETS = {
    "Spoken_Dialect_QA": (None, "answers", "dev"),
    "speech_fairness": ("audio", "transcription", "test"),
    "non_social_HeySquad_QA": ("audio", "answers", "validation"),
    "non_social_SLURP_speaker_intent": ("audio", "text_intent", "test"),
    "IEMOCAP_emotion_recognition": ("audio", "emotion_label", "session5"),
    "MELD_emotion_recognition": ("audio", "emotion_label", "test"),
    "Mustard_sarcasm": ("audio", "sarcasm", "train"),
    "CommonVoice_speaker_identity": ("audio", "sentence", "test"),
    "FLEURS_speaker_identity": ("audio", "gender", "test"),
    "Callhome_relationships": ("audio", "Speaker A - Primary", "train"),
    "URFunny_humor": ("audio", "label", "train"),
    "COVOST_translation": ("audio", "translation", "validation"),
}

# Clip keys of the laughter-reason test list, in list order (fixed values).
LAUGHTER_KEYS = [
    "1_80", "1_1001", "1_10810", "1_10857", "1_10859", "1_11042", "1_11046", "1_11201",
    "1_11236", "1_11529", "1_11928", "1_1666", "1_1678", "1_1722", "1_2075", "1_2420",
    "1_2423", "1_2830", "1_3069", "1_3177", "1_3204", "1_3649", "1_3837", "1_3840", "1_4352",
    "1_4603", "1_4792", "1_4949", "1_5109", "2_590", "2_559", "1_8505", "1_9009", "2_225",
    "2_264", "2_268", "1_7494", "1_7341", "1_6860", "1_6645",
    1402, 3956, 2751, 9984, 8066, 1150, 9789, 3812, 2532, 3049, 6225, 1197, 7966, 956, 5072,
    2420, 4236, 1695, 8241, 3435, 5251, 6337, 6240, 8558, 3809, 4240, 1057, 6915, 5532, 3369,
    2807, 620, 6744, 7880, 3740, 2750, 5378, 6575, 8328, 878,
]

# Split ratio, seed, shard count, vote goal, k-means rounds and decay (fixed values).
TEST_SHARE = 0.2
SPLIT_SEED = 42
SHARD_COUNT = 14
VOTE_GOAL = 10
KMEANS_ROUNDS = 10
EMA_DECAY = 0.99
CLIP_SECONDS = 30
FBANK_MEAN = 15.41663
FBANK_STD = 6.55582
COMPLETION_TEXT = "# Completed! Completion Code: {}"
COMPLETION_CODE = "PLACEHOLDER"
PROGRESS_TEXT = "# {}/{} Preferences Submitted"
