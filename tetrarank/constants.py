"""Vocabularies, lookup tables and thresholds that results depend on."""

# The four signals, in canonical order.
EXPERTS = ["alpha", "beta", "gamma", "delta"]
DZ_COLUMNS = ["dz_alpha", "dz_beta", "dz_gamma", "dz_delta"]
MIX_COLUMNS = ["mix_alpha", "mix_beta", "mix_gamma", "mix_delta"]

# The eight emotions, in canonical order.
EMOTIONS = ["Joy", "Trust", "Fear", "Anticipation", "Sadness", "Anger", "Surprise", "Disgust"]

# Keyword lexicon for guessing the emotion of a prompt.
EMOTION_LEXICON = {
    "Joy": ["joy", "happy", "happiness", "funny", "feelgood", "feel-good", "uplifting", "heartwarming",
            "delight", "wholesome"],
    "Trust": ["trust", "loyal", "loyalty", "faith", "reliable", "comforting", "reassuring"],
    "Fear": ["fear", "scary", "terror", "horror", "creepy", "tense", "thriller", "dread"],
    "Anticipation": ["anticipation", "exciting", "excited", "suspense", "hope", "hopeful", "build-up",
                     "await", "yearning"],
    "Sadness": ["sad", "tragic", "melancholy", "bittersweet", "tearjerker", "grief", "somber"],
    "Anger": ["anger", "angry", "rage", "furious", "vengeful", "revenge", "wrath"],
    "Surprise": ["surprise", "twist", "unexpected", "shocking", "mind-bending", "reveal"],
    "Disgust": ["disgust", "gross", "repulsive", "nasty", "vile"],
}

# Loose emotion labels (lower case) and the canonical emotion they stand for.
EMOTION_SYNONYMS = {
    "joy": "Joy", "happiness": "Joy", "happy": "Joy", "amusement": "Joy", "delight": "Joy",
    "trust": "Trust", "loyalty": "Trust", "faith": "Trust",
    "fear": "Fear", "terror": "Fear", "scare": "Fear",
    "anticipation": "Anticipation", "expectation": "Anticipation", "eagerness": "Anticipation",
    "sadness": "Sadness", "grief": "Sadness", "sorrow": "Sadness",
    "anger": "Anger", "rage": "Anger", "annoyance": "Anger",
    "surprise": "Surprise", "astonishment": "Surprise", "shock": "Surprise",
    "disgust": "Disgust", "revulsion": "Disgust", "aversion": "Disgust",
}

# Emotions a genre contributes to.
GENRE_EMOTIONS = {
    "Comedy": ["Joy"], "Romance": ["Joy"], "Children's": ["Joy"], "Animation": ["Joy"], "Musical": ["Joy"],
    "Documentary": ["Trust"], "War": ["Trust", "Anger"], "Western": ["Trust"],
    "Action": ["Anger"], "Crime": ["Anger", "Disgust"], "Horror": ["Fear", "Disgust"],
    "Thriller": ["Fear", "Surprise"], "Mystery": ["Surprise", "Anticipation"], "Fantasy": ["Surprise"],
    "Adventure": ["Anticipation"], "Sci-Fi": ["Anticipation"], "Drama": ["Sadness"], "Film-Noir": ["Sadness"],
}
GENRE_PRIOR = 0.1

# Words ignored when matching prompt tokens.
PROMPT_STOPWORDS = [
    "a", "an", "the", "and", "of", "in", "on", "for", "with", "to", "is", "my", "your", "i", "me", "you",
    "any", "some", "about", "that", "this", "it", "like", "just", "we", "us", "want", "looking", "need",
]

# Keys under which ids, titles, prompt texts and hit scores may appear.
ID_KEYS = ["movieId", "movie_id", "id", "tmdb_id", "imdb_id"]
TITLE_KEYS = ["title", "name", "original_title", "originalName", "movie_title"]
PROMPT_TEXT_KEYS = ["prompt_text", "text", "query", "q_text", "prompt"]
HIT_ID_KEYS = ["movieId", "movie_id", "movie"]
HIT_SCORE_KEYS = ["score", "sim", "value", "bm25", "score_dense", "score_bm25", "dense_score", "bm25_score"]

# Item metadata carried along with chunks and hits.
ITEM_META = ["movieId", "title", "original_title", "original_language", "release_date", "TMDbID", "runtime",
             "type", "adult", "production_countries", "spoken_languages", "poster_path"]

# BM25 and tie defaults.
BM25_K1 = 1.5
BM25_B = 0.75
TIE_TOLERANCE = 0.05
NO_SIGNAL_TOLERANCE = 1e-8
