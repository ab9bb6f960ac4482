"""Word lists and small lookup tables. All are parameters of the functions that use them."""

import unicodedata

# English stop words of the public NLTK corpus.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Extra stop words for grouping comments by product.
PRODUCT_STOP_WORDS = [
    "like", "get", "go", "would", "could", "should", "also", "really", "much", "many", "good",
    "great", "love", "nice", "best", "use", "using", "used", "got", "going", "even", "still",
    "just", "want", "need", "make", "made", "way", "time", "day", "work", "works", "try", "tried",
    "buy", "bought", "look", "looks", "please", "one", "cute", "thank", "thanks", "video", "hai",
    "hi", "wow", "people", "think", "omg", "ur", "bro", "without", "better", "see", "seen",
    "thing", "things", "say", "said", "tell", "come", "came", "back", "first", "second", "last",
    "next", "new", "old", "right", "left", "yes", "yeah", "okay", "ok", "well", "maybe",
    "probably", "actually", "totally", "super", "pretty", "very", "quite", "definitely",
    "absolutely", "completely", "name", "lol", "always", "black", "real", "im", "men", "videos",
    "never", "wig", "share", "dont", "long", "stunning", "put", "thought", "song", "dear", "every",
    "oh", "stop", "pls",
]

# Tokens kept although they are short.
KEPT_SHORT_TOKENS = [
    "i", "a", "is", "it", "me", "my", "we", "he", "be", "do", "so", "no", "up", "on", "in", "at",
    "to", "of", "or",
]

# Chat abbreviations and what they stand for.
SLANG = {
    "bc": "because", "ur": "your", "u": "you", "r": "are", "n": "and", "w/": "with", "b4": "before",
    "2": "to", "4": "for", "luv": "love", "plz": "please", "thx": "thanks", "omg": "oh my god",
    "lol": "laugh out loud", "brb": "be right back", "ttyl": "talk to you later",
    "idk": "i do not know", "tbh": "to be honest", "imo": "in my opinion",
    "imho": "in my humble opinion", "fyi": "for your information", "aka": "also known as",
    "asap": "as soon as possible", "btw": "by the way", "eww": "disgusting",
}

# Product words whose corpus weight is raised, and the factor.
PRODUCT_TERMS = [
    "makeup", "lipstick", "foundation", "mascara", "eyeliner", "eyeshadow", "blush", "primer",
    "concealer", "powder", "serum", "toner", "shampoo", "perfume", "spf",
]
PRODUCT_TERM_FACTOR = 5.0

# A small demonstration table of word forms; pass a full one for production use.
DEMO_LEMMAS = {
    "products": "product", "brands": "brand", "shades": "shade", "colors": "color",
    "colours": "colour", "lipsticks": "lipstick", "foundations": "foundation",
    "mascaras": "mascara", "creams": "cream", "serums": "serum", "brushes": "brush",
    "lashes": "lash", "cheveux": "cheveu", "eyes": "eye", "lips": "lip", "feels": "feel",
    "feeling": "feel", "felt": "feel", "takes": "take", "took": "take", "taken": "take",
    "shipping": "ship", "shipped": "ship", "checking": "check", "checked": "check",
    "amazing": "amaze", "obsessed": "obsess", "recommended": "recommend",
    "recommends": "recommend", "worse": "bad", "worst": "bad", "deals": "deal", "ed": "ed",
}

# Names that differ from the Unicode character name, as used by common emoji libraries.
EMOJI_SHORT_NAMES = {
    "😀": "grinning_face", "😁": "beaming_face_with_smiling_eyes",
    "😃": "grinning_face_with_big_eyes", "😄": "grinning_face_with_smiling_eyes",
    "😅": "grinning_face_with_sweat", "😆": "grinning_squinting_face",
    "😉": "winking_face", "😊": "smiling_face_with_smiling_eyes",
    "😍": "smiling_face_with_heart-eyes", "😘": "face_blowing_a_kiss",
    "😋": "face_savoring_food", "😎": "smiling_face_with_sunglasses",
    "👍": "thumbs_up", "👎": "thumbs_down", "👏": "clapping_hands", "🙏": "folded_hands",
    "💯": "hundred_points", "🔥": "fire", "❤": "red_heart", "💔": "broken_heart",
    "💇": "person_getting_haircut", "💄": "lipstick", "💅": "nail_polish", "✨": "sparkles",
}


# What a person joined with a thing is called, and the names of skin tones.
OCCUPATIONS = {
    "💻": "technologist", "⚕": "health_worker", "🎓": "student", "🏫": "teacher", "⚖": "judge", "🌾": "farmer",
    "🍳": "cook", "🔧": "mechanic", "🏭": "factory_worker", "💼": "office_worker", "🔬": "scientist",
    "🎤": "singer", "🎨": "artist", "✈": "pilot", "🚀": "astronaut", "🚒": "firefighter",
}
TONES = {
    "🏻": "light_skin_tone", "🏼": "medium-light_skin_tone", "🏽": "medium_skin_tone", "🏾": "medium-dark_skin_tone",
    "🏿": "dark_skin_tone",
}
PERSONS = {"👨": "man", "👩": "woman", "🧑": "person"}
SIGNS = {"♀": "woman", "♂": "man"}


def emoji_names(first: int = 0x1F300, last: int = 0x1FAFF) -> dict[str, str]:
    """Emoji -> name, from the Unicode names of the pictographic blocks plus the short names above."""
    names = {}
    for block in (range(0x2600, 0x27C0), range(0x2B00, 0x2C00), range(first, last + 1)):
        for code in block:
            name = unicodedata.name(chr(code), "")
            if name and unicodedata.category(chr(code)) == "So":
                names[chr(code)] = name.lower().replace(" ", "_")
    names.update(EMOJI_SHORT_NAMES)
    return names
