"""Regular expressions in a form that Java and RE2 read alike, and the engine's fixed values."""

from html.entities import name2codepoint

# Unicode white space with the separators 1C to 1F, as a class and negated.
_SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{_SPACES}]"
NON_WS = f"[^{_SPACES}]"
# The same characters as a string.
WS_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LETTER = r"\p{L}"

# What cleaning removes, in the order in which it does. The range $ to _ holds digits, capitals and most marks.
URL = r"https?://[!$-_a-z]+"
WWW = r"www\.[$-_a-z]+"
SHORTENERS = ("bit.ly/", "t.co/", "goo.gl/", "tinyurl.com/")
SHORTENER = rf"\b(?:bit\.ly|t\.co|goo\.gl|tinyurl\.com)/{NON_WS}+"
EMAIL = rf"{NON_WS}+@{NON_WS}+"
# The same for Java, which would otherwise try each character of a long run as a start.
EMAIL_ANCHORED = rf"(?<!{NON_WS}){EMAIL}"
EMOTICON = r"[:;=8][\-o\*']?[\)\]\(\[dDpP/\:\}\{@\|\\]"
PUNCTUATION_RUN = r"[!?.]+([!?.])"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}\x{2B00}-\x{2BFF}]+"
NON_LATIN = r"[^\x00-\x7F\x{C0}-\x{17F}]+"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
DELETED = r"(?i)\[deleted\]|\[removed\]|\[redacted\]"
POSTED_BY = rf"Posted by u/{NON_WS}+"
SUBREDDIT = rf"r/{NON_WS}+"
BOILERPLATE = (
    "(?i)Click here to subscribe",
    "(?i)Follow us on",
    "(?i)Share this:",
    "(?i)Like this:",
    "(?i)Posted on [0-9]+",
    "(?i)[0-9]+ likes?",
    "(?i)[0-9]+ shares?",
    "(?i)[0-9]+ comments?",
)
# What a text must hold for one of these to be found: a phrase in lower case, or a number and a word.
BOILERPLATE_PHRASES = ("click here to subscribe", "follow us on", "share this:", "like this:", "posted on ")
BOILERPLATE_COUNT = "[0-9] (?i:like|share|comment)"
REPEATED = r"(?d)(.)\1{3,}"
DOCX_SYMBOL = rf"[^\p{{L}}\p{{N}}_{_SPACES}.,;:!?'-]"

# HTML: dropped with their contents, then all other markup.
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_DROPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Where the last end of those stands, in the reversed text.
HTML_DROPPED_END = r"(?i)>\s*(?:tpircs|elyts)/<"
HTML_TAG = r"(?s)<[/!?]?[A-Za-z][^>]*>"
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

# Where a sentence ends, on text whose white space is collapsed: marks stand in for what must not and what may be split.
ABBREVIATION_END = r"([\p{L}\p{N}_]\.[\p{L}\p{N}_][.?!]) "
TITLE_END = r"([A-Z][a-z]\.) "
SENTENCE_END = r"([.?!]) "
VOWELS = "[aeiouyàâäáãåæèéêëìíîïòóôöõøœùúûüÿ]+"

# Prefixes of assistants, the first that matches goes.
ASSISTANT_PREFIXES = ("Sure, ", "Sure! ", "Certainly! ", "Certainly, ", "Of course! ", "Of course, ", "Absolutely! ", "I'd be happy to ", "I would be happy to ")
# Marks of books' front and back matter.
BOOK_NOISE = ("PROJECT GUTENBERG", "PRODUCED BY", "START OF THIS", "END OF THIS", "GUTENBERG LICENSE")
# Contractions written out, and long sentences broken at commas.
CONTRACTIONS = (
    ("can't", "cannot"), ("won't", "will not"), ("don't", "do not"), ("I'm", "I am"), ("it's", "it is"), ("you're", "you are"), ("they're", "they are"), ("we're", "we are"),
    ("isn't", "is not"), ("aren't", "are not"), ("wasn't", "was not"), ("weren't", "were not"), ("haven't", "have not"), ("hasn't", "has not"), ("hadn't", "had not"), (", ", ". "),
)
OPENER, FILLERS = "Basically, ", ("Honestly, ", "Frankly, ", "You see, ", "Actually, ")
FILLER_PREFIXES, FILLER_SUFFIXES = ("So ", "Yeah ", "I mean "), (" honestly", " tbh")
INSTRUCTION = "Humanize the following text"

# Labels by the least value at which they hold, the highest first; the last holds for the rest.
BURSTINESS_LABELS = ((0.5, "Very High (Strong human characteristics)"), (0.2, "High (Likely human-written)"), (0.0, "Moderate (Mixed or edited content)"), (-0.2, "Low (Possibly AI-generated)"), (None, "Very Low (Likely AI-generated)"))
EASE_LABELS = ((90, "Very Easy (5th grade)"), (80, "Easy (6th grade)"), (70, "Fairly Easy (7th grade)"), (60, "Standard (8th-9th grade)"), (50, "Fairly Difficult (10th-12th grade)"), (30, "Difficult (College level)"), (None, "Very Difficult (Graduate level)"))
SOURCE_LABELS = ((70, "Human-written"), (55, "Human-written"), (45, "Mixed/Unclear"), (30, "AI-generated"), (None, "AI-generated"))
CONFIDENCE_LABELS = ((70, "High"), (55, "Medium"), (45, "Low"), (30, "Medium"), (None, "High"))
# Labels by the most value at which they hold (grades), or the value below which they do (the others).
GRADE_LABELS = ((5, "Elementary school level"), (8, "Middle school level"), (12, "High school level"), (16, "College level"), (None, "Graduate/Professional level"))
PERPLEXITY_LABELS = ((50, "Very low (likely AI-generated)"), (100, "Low (possibly AI-generated)"), (200, "Moderate (mixed or edited)"), (500, "High (likely human-written)"), (None, "Very high (likely human-written)"))
GRAMMAR_LABELS = ((1, "Very Good (minimal errors)"), (3, "Good (few errors)"), (5, "Fair (some errors)"), (10, "Poor (many errors)"), (None, "Very Poor (excessive errors)"))
NO_GRAMMAR_ERRORS = "Excellent (no errors)"
FEW_SENTENCES, NO_TEXT = "Insufficient data (need 2+ sentences)", "N/A"
# The human score's weights.
SCORE_WEIGHTS = {"perplexity": 0.35, "burstiness": 0.35, "grammar": 0.15, "cv": 0.15}
# Histogram bins, as the highest value of each.
LENGTH_BINS = ((100, "0-100"), (500, "101-500"), (1000, "501-1000"), (5000, "1001-5000"), (None, "5001+"))
SENTENCE_BINS = ((5, "1-5"), (10, "6-10"), (20, "11-20"), (30, "21-30"), (None, "31+"))
TOKEN_BINS = (0, 128, 256, 512, 1024, 2048)
