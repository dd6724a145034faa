"""Fixed values that results depend on: word lists, patterns, thresholds. Nothing here is logic."""

# Domains in order, with keywords, patterns to avoid, word range and target share.
DOMAINS = {
    "conversational": {
        "keywords": ["think", "feel", "really", "pretty", "kind of", "sort of", "maybe", "probably"],
        "avoid": [r"\d{4}", r"[A-Z]{3,}", r"@", r"http", r"www"],
        "words": (5, 18),
        "share": 0.25,
    },
    "professional": {
        "keywords": ["project", "meeting", "deadline", "team", "client", "strategy", "process", "report"],
        "avoid": [r"\$\d+", r"%", r"CEO|CFO|CTO", r"Q[1-4]"],
        "words": (6, 20),
        "share": 0.20,
    },
    "educational": {
        "keywords": ["study", "learn", "research", "understand", "explain", "theory", "method", "analysis"],
        "avoid": [r"Figure \d+", r"Table \d+", r"Chapter \d+", r"pp\. \d+"],
        "words": (7, 22),
        "share": 0.20,
    },
    "creative": {
        "keywords": ["suddenly", "quietly", "beautiful", "mysterious", "ancient", "journey", "discover", "imagine"],
        "avoid": [r"Chapter \d+", r"Part \d+", r"ISBN", r"copyright"],
        "words": (6, 25),
        "share": 0.15,
    },
    "instructional": {
        "keywords": ["first", "next", "then", "finally", "step", "process", "method", "ensure", "make sure"],
        "avoid": [r"Step \d+", r"\d+\.", r"a\)", r"b\)", r"i\."],
        "words": (5, 20),
        "share": 0.10,
    },
    "general": {
        "keywords": [],
        "avoid": [r"===", r"\[\[", r"\]\]", r"\{\{", r"\}\}", r"Category:"],
        "words": (5, 18),
        "share": 0.10,
    },
}

# What adds to a domain's score: (points, phrases of which one must be contained, in lower case).
BONUS_PHRASES = {
    "conversational": (3, ["i ", "you ", "we ", "they "]),
    "professional": (3, ["will", "should", "must", "need to"]),
    "educational": (5, ["according to", "research shows", "studies indicate"]),
    "creative": (3, ["once", "long ago", "in the", "there was"]),
    "instructional": (5, ["first", "second", "next", "then", "finally"]),
}
# Whole words of which one adds 3 points.
BONUS_WORDS = {
    "professional": ["company", "business", "organization", "department"],
    "educational": ["study", "research", "data", "evidence", "findings"],
}
# Beginnings of which one adds 3 points.
BONUS_STARTS = {"instructional": ["make sure", "be sure", "remember to", "don't forget"]}

# Patterns a good sentence has none of.
BAD_SENTENCE = [
    r"^[A-Z\s]+$",
    r"\d{4,}",
    r"http|www|@",
    r"===|---|\*\*\*",
    r"[<>{}\[\]\\]",
    r"\([^)]{30,}\)",
    r'"[^"]{50,}"',
    r"\.{3,}|!{2,}|\?{2,}",
    r"(^|[^\p{L}\p{N}_])[A-Z]{3,}([^\p{L}\p{N}_].*[^\p{L}\p{N}_]|[^\p{L}\p{N}_])[A-Z]{3,}([^\p{L}\p{N}_]|$)",
]

# Neighbouring keys.
KEYBOARD = {
    "q": "was", "w": "qeasd", "e": "wrsdf", "r": "etdfg", "t": "ryfgh", "y": "tughj", "u": "yihjk", "i": "uojkl", "o": "ipkl", "p": "ol",
    "a": "qwsz", "s": "weadzx", "d": "ersfxc", "f": "rtdgcv", "g": "tyfhvb", "h": "yugjbn", "j": "uihknm", "k": "iojlm", "l": "opk",
    "z": "asx", "x": "sdzc", "c": "dfxv", "v": "fgcb", "b": "ghvn", "n": "hjbm", "m": "jkn",
}
# Neighbouring keys as the profiler sees them.
KEYBOARD_PROFILE = {
    "q": "wa", "w": "qeas", "e": "wrsd", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol",
    "a": "qws", "s": "awde", "d": "serf", "f": "drtg", "g": "ftyh", "h": "gyuj", "j": "huik", "k": "jiol", "l": "kop",
    "z": "ax", "x": "zsc", "c": "xdf", "v": "cfb", "b": "vgn", "n": "bhm", "m": "nj",
}
# Neighbouring keys of the earlier generator.
KEYBOARD_EARLY = {
    "q": "wa", "w": "qeas", "e": "wrsd", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol",
    "a": "qws", "s": "wead", "d": "ersf", "f": "rtdg", "g": "tyfh", "h": "yugj", "j": "uihk", "k": "iojl", "l": "opk",
    "z": "x", "x": "zc", "c": "xv", "v": "cb", "b": "vn", "n": "bm", "m": "n",
}
# Characters alike in sound or shape.
SIMILAR = {"a": "eo", "e": "ai", "i": "eo", "o": "au", "u": "oi", "b": "pv", "p": "b", "v": "bf", "f": "v", "g": "c", "c": "g", "d": "t", "t": "d", "n": "m", "m": "n", "l": "r", "r": "l"}

# Words that sound alike.
HOMOPHONES = {
    "there": ["their", "they're"], "their": ["there", "they're"], "they're": ["there", "their"], "to": ["too", "two"], "too": ["to", "two"], "two": ["to", "too"],
    "your": ["you're"], "you're": ["your"], "its": ["it's"], "it's": ["its"], "then": ["than"], "than": ["then"], "affect": ["effect"], "effect": ["affect"],
    "accept": ["except"], "except": ["accept"], "lose": ["loose"], "loose": ["lose"], "choose": ["chose"], "chose": ["choose"], "break": ["brake"], "brake": ["break"],
    "piece": ["peace"], "peace": ["piece"], "hear": ["here"], "here": ["hear"], "wear": ["where"], "where": ["wear"], "weather": ["whether"], "whether": ["weather"],
}
# Common misspellings.
MISSPELLINGS = {
    "definitely": ["definately", "definatly", "defiantly"],
    "separate": ["seperate", "seprate", "separat"],
    "necessary": ["neccessary", "necesary", "neccesary"],
    "receive": ["recieve", "recive", "receve"],
    "believe": ["beleive", "belive", "beleave"],
    "achieve": ["acheive", "achive", "acheve"],
    "occurred": ["occured", "occurrd", "ocurred"],
    "beginning": ["begining", "beggining", "begininng"],
    "embarrass": ["embarass", "embarras", "embaress"],
    "government": ["goverment", "govenment", "govermnent"],
    "restaurant": ["restarant", "resturant", "restaurent"],
    "business": ["buisness", "bussiness", "busines"],
    "tomorrow": ["tomarow", "tomorow", "tommorow"],
    "language": ["langauge", "languag", "lanuage"],
    "experience": ["experiance", "experince", "expereince"],
    "different": ["diferent", "diffrent", "diferrent"],
    "important": ["importent", "importnt", "imporant"],
    "because": ["becuase", "beacuse", "becaus"],
    "beautiful": ["beatiful", "beutiful", "beautifull"],
    "friend": ["freind", "frend", "freend"],
    "sentence": ["sentnce", "sentance", "sentense"],
    "remember": ["remeber", "remmeber", "remembr"],
    "exercise": ["excercise", "exersize", "exercize"],
}
# Contractions written wrongly. Keys with a capital never match a lower-cased word.
CONTRACTIONS = {
    "don't": ["dont", "do not"], "can't": ["cant", "cannot"], "won't": ["wont", "will not"], "isn't": ["isnt", "is not"], "aren't": ["arent", "are not"], "wasn't": ["wasnt", "was not"],
    "weren't": ["werent", "were not"], "doesn't": ["doesnt", "does not"], "didn't": ["didnt", "did not"], "shouldn't": ["shouldnt", "should not"], "wouldn't": ["wouldnt", "would not"],
    "couldn't": ["couldnt", "could not"], "I'm": ["Im", "I am"], "you're": ["youre", "you are"], "we're": ["were", "we are"], "they're": ["theyre", "they are"], "I've": ["Ive", "I have"],
    "you've": ["youve", "you have"], "we've": ["weve", "we have"], "they've": ["theyve", "they have"], "I'll": ["Ill", "I will"], "you'll": ["youll", "you will"], "we'll": ["well", "we will"], "they'll": ["theyll", "they will"],
}
# Double letters dropped.
DOUBLE_LETTERS = {
    "accommodate": "accomodate", "occurring": "occuring", "beginning": "begining", "committee": "commitee", "possess": "posess", "address": "adress",
    "success": "sucess", "access": "acess", "goddess": "godess", "process": "proces", "necessary": "necesary", "embarrass": "embaras",
}
# Compounds torn apart.
COMPOUNDS = {
    "anyway": "any way", "everyone": "every one", "someone": "some one", "anything": "any thing", "everything": "every thing", "something": "some thing", "everybody": "every body",
    "somebody": "some body", "anybody": "any body", "nobody": "no body", "everywhere": "every where", "somewhere": "some where", "anywhere": "any where", "nowhere": "no where",
    "into": "in to", "onto": "on to", "cannot": "can not", "forever": "for ever",
}
# Spellings by sound, in order.
PHONETIC_RULES = [("ph", "f"), ("ough", "uff"), ("augh", "af"), ("eigh", "ay"), ("tion", "sion"), ("cious", "sious"), ("ence", "ance"), ("ance", "ence")]
# Pairs that make a change look phonetic, in either direction.
PHONETIC_PAIRS = [("ph", "f"), ("ough", "uff"), ("eigh", "ay"), ("tion", "sion"), ("c", "s"), ("s", "c"), ("f", "ph"), ("i", "y"), ("y", "i")]
# Pairs the profiler takes for phonetic, from clean to corrupted.
PHONETIC_PROFILE = [("ph", "f"), ("f", "ph"), ("c", "s"), ("s", "c"), ("i", "y"), ("y", "i"), ("tion", "sion"), ("sion", "tion")]
# Grammar confusions.
GRAMMAR_PAIRS = [("then", "than"), ("than", "then"), ("their", "there"), ("there", "their"), ("your", "you're"), ("you're", "your")]
# Words after which "than" is right.
COMPARATIVES = ["better", "more", "less", "rather"]
# Confusions of the earlier generator.
CONFUSIONS = {
    "their": "there", "there": "their", "they're": "their", "your": "you're", "you're": "your", "its": "it's", "it's": "its",
    "too": "to", "to": "too", "than": "then", "then": "than", "affect": "effect", "effect": "affect", "lose": "loose", "loose": "lose",
}
# Weights of error types in the difficulty score, and in choosing one.
DIFFICULTY = {"keyboard": 0.6, "spelling": 0.8, "phonetic": 1.0, "grammar": 1.2, "punctuation": 0.7, "spacing": 0.5}
CHOICE = {"spelling": 0.3, "phonetic": 0.25, "keyboard": 0.2}

# Limits of the row checks.
LIMITS = {"min_words": 4, "max_words": 30, "min_chars": 20, "min_change": 0.05, "max_change": 0.50, "min_word_change": 0.10, "min_readability": 0.3, "max_run": 3, "max_nonsense": 0.3}
# Patterns that flag a row, in either text.
SUSPECT = [
    r"^[A-Z\s]+$",
    r"\d{4,}",
    r"http|www|@|\.com",
    r"[<>{}\[\]\\|]",
    r"\.{3,}|\?{2,}|!{2,}",
    r"(^|[^\p{L}\p{N}_])[bcdfghjklmnpqrstvwxz]{4,}([^\p{L}\p{N}_]|$)",
    r"(.)\1{3,}",
    r"[\p{L}\p{N}_]{20,}",
]
# Shares a dataset should have.
COMPLEXITY_RANGES = {"simple": (0.25, 0.35), "medium": (0.45, 0.55), "complex": (0.15, 0.25)}
ERROR_TYPE_LEAST = {"spelling": 0.40, "phonetic": 0.15, "keyboard": 0.20, "punctuation": 0.10}
# Abbreviations after which a final period stays.
ABBREVIATIONS = ["etc.", "Mr.", "Ms.", "Dr.", "Inc.", "Ltd."]
# Prompts by name; {} is the text.
PROMPTS = {
    "fix": "Fix: {}",
    "fix_typos": "fix typos: {}",
    "correct_typos": "correct typos: {}",
    "fix_spelling": "fix spelling errors: {}",
    "fix_spelling_short": "fix spelling: {}",
    "correct_spelling": "correct spelling errors: {}",
    "bytes_prefix": "fix spelling errors only, don't change the meaning of the text: {}",
    "completion": "Correct spelling: {}\nCorrected: ",
    "minimal_context": "Fix: {}\n",
    "few_shot_plain": """Fix typos in these sentences:

Input: I beleive this is teh answer.
Output: I believe this is the answer.

Input: She recieved her degre yesterday.
Output: She received her degree yesterday.

Input: The resturant serves good food.
Output: The restaurant serves good food.

Input: {}
Output:""",
}
# What a user's turn asks of a chat model, by name; the turn is put between the marks of a chat.
TURNS = {
    "zero_shot": "Correct the typos in this text: {}",
    "minimal_changes": "Fix only the spelling errors in this text, change nothing else: {}",
    "conservative": "Correct only the typos in this text. Do not change the meaning or add information: {}",
    "strict": "Fix the spelling mistakes. Keep everything else exactly the same: {}",
    "constraint": "Correct spelling errors only. Do not change times, dates, or other details: {}",
    "ultra_short": "Correct: {}",
    "direct": "{}\n\nFix spelling only:",
    "stop_at_period": "Correct typos: {}",
    "few_shot": """Here are examples of correcting typos while keeping everything else the same:

Input: I cant beleive its raining agian today.
Output: I can't believe it's raining again today.

Input: The conferance will be held at 3pm tomorow.
Output: The conference will be held at 3pm tomorrow.

Input: Please send me the documnet by friday morning.
Output: Please send me the document by friday morning.

Now correct the typos in this text: {}""",
    "few_shot_explicit": """Fix only spelling errors. Keep times, dates, and all other details exactly the same.

Examples:
- "I cant beleive its raining agian today." → "I can't believe it's raining again today."
- "The conferance will be held at 3pm tomorow." → "The conference will be held at 3pm tomorrow."
- "Please send me the documnet by friday morning." → "Please send me the document by friday morning."

Correct the typos: {}""",
    "few_shot_cautious": """Fix only spelling errors. Keep times, dates, and all other details exactly the same.

Examples:
- "I cant beleive its raining agian today." → "I can't believe it's raining again today."
- "The conferance will be held at 3pm tomorow." → "The conference will be held at 3pm tomorrow."
- "Please send me the documnet by friday morning." → "Please send me the document by friday morning."
- "We need to discus the projcet detials today" → "We need to discuss the project details today"

Correct the typos: {}""",
}
# The text around the functions that a chat offers.
TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_AFTER = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
# The user's line of a chat example.
CHAT_PROMPT = "Correct the typos in this text: "
# Generator methods, the source name each writes, and their shares.
METHODS = {
    "multi_error_sentences": ("multi_error_advanced", 0.40),
    "contextual_phonetic": ("contextual_phonetic", 0.20),
    "advanced_typography": ("advanced_typography", 0.15),
    "keyboard_patterns": ("keyboard_patterns", 0.15),
    "simple_single": ("simple_single", 0.10),
}
# Names of the generator's sources end so where the period was taken.
NO_PERIOD = "_no_punct"
# Pairs of column names that hold source and target, in order.
COLUMN_PAIRS = [("corrupted", "clean"), ("input", "target"), ("source", "target"), ("noisy", "clean"), ("text", "label"), ("src", "tgt")]
# Prefixes and markers that output cleaning removes.
MARKERS = ["Input:", "Output:", "Human:", "Assistant:"]


def _span(*ranges: tuple[int, int]) -> str:
    return "".join(chr(i) for a, b in ranges for i in range(a, b + 1))


# Letters whose case is a matter of the Unicode version, or whose full upper form is longer than a character. DuckDB's tables are the rule:
# a character becomes one character (first, last and distance to the upper form), or stays; letters that Java's \p{Lu} does not know yet.
_SIMPLE = [(0xdf, 0xdf, 7615), (0x1f80, 0x1f87, 8), (0x1f90, 0x1f97, 8), (0x1fa0, 0x1fa7, 8), (0x1fb3, 0x1fb3, 9), (0x1fc3, 0x1fc3, 9), (0x1ff3, 0x1ff3, 9)]
UPPER_SIMPLE = ("".join(_span((a, b)) for a, b, _ in _SIMPLE), "".join(_span((a + n, b + n)) for a, b, n in _SIMPLE))
UPPER_KEPT = _span((0x149, 0x149), (0x19b, 0x19b), (0x1f0, 0x1f0), (0x264, 0x264), (0x390, 0x390), (0x3b0, 0x3b0), (0x587, 0x587), (0x1c8a, 0x1c8a), (0x1e96, 0x1e9a), (0x1f50, 0x1f50), (0x1f52, 0x1f52), (0x1f54, 0x1f54), (0x1f56, 0x1f56), (0x1f88, 0x1f8f), (0x1f98, 0x1f9f), (0x1fa8, 0x1faf), (0x1fb2, 0x1fb2), (0x1fb4, 0x1fb4), (0x1fb6, 0x1fb7), (0x1fbc, 0x1fbc), (0x1fc2, 0x1fc2), (0x1fc4, 0x1fc4), (0x1fc6, 0x1fc7), (0x1fcc, 0x1fcc), (0x1fd2, 0x1fd3), (0x1fd6, 0x1fd7), (0x1fe2, 0x1fe4), (0x1fe6, 0x1fe7), (0x1ff2, 0x1ff2), (0x1ff4, 0x1ff4), (0x1ff6, 0x1ff7), (0x1ffc, 0x1ffc), (0xa7cd, 0xa7cd), (0xa7db, 0xa7db), (0xfb00, 0xfb06), (0xfb13, 0xfb17), (0x10d70, 0x10d85))
LOWER_KEPT = _span((0x1c89, 0x1c89), (0xa7cb, 0xa7cc), (0xa7da, 0xa7da), (0xa7dc, 0xa7dc), (0x10d50, 0x10d65))
UPPER_LETTERS = _span((0x2c2f, 0x2c2f), (0xa7c0, 0xa7c0), (0xa7d0, 0xa7d0), (0xa7d6, 0xa7d6), (0xa7d8, 0xa7d8), (0x10570, 0x1057a), (0x1057c, 0x1058a), (0x1058c, 0x10592), (0x10594, 0x10595))
