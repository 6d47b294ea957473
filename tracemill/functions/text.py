"""Column expressions over instruction text: words, intent, scope, surface predicates, archetypes, secrets.

Regular expressions are Unicode-aware and ignore case where ``(?iU)`` says so. A null text is treated as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: verb classes with base scores, in order; the first that matches wins -----------------------------
VERB_CLASSES = [
    ("trivial", 0.10, r"\b(commit message|typo|rename|readme|title|format|lint)\b"),
    ("explain", 0.20, r"^(what|why|how|explain|describe|tell me|walk me|give me (a |an )?(overview|summary))"),
    ("small_edit", 0.35, r"^(add|update|change|remove|delete|move|tweak)\b"),
    ("write", 0.45, r"^(write|create|implement|build|generate|make)\b"),
    ("fix", 0.55, r"\b(fix|debug|resolve|failing|broken|crash|error|investigate|why (is|does)nt?)\b"),
    ("hard", 0.85, r"\b(refactor|migrat|redesign|architect|overhaul|rewrite)\b"),
]
UNKNOWN_SCORE = 0.5
SCOPE_BROAD = r"\b(across (the )?(codebase|repo|services|modules|files)|everywhere|all (files|modules|call ?sites)|entire)\b"
SCOPE_NARROW = r"\b(this (function|file|line|variable|test)|just|only)\b"
TERSE = r"^\W*(go\s*ahead|do it|do so|go for it|ok(ay)?|ye(s|p|ah)|sure|lgtm|ship it|proceed|continue|carry on|try now|and now|next|fine|please do|sounds good|do that|make it so)\W*$"
CORPUS_INTENTS = [
    ("explain", r"^(what|why|how|explain|describe|tell me|can you (tell|explain))"),
    ("fix", r"^(fix|debug|resolve|why (is|does).*(fail|crash|error))"),
    ("write", r"^(write|create|add|implement|build|generate|make)"),
    ("edit", r"^(rename|update|change|modify|remove|delete|move)"),
    ("run", r"^(run|execute|test|try|check|verify)"),
]
EASY_INTENT = r"\b(commit message|summar|rename|readme|title|typo|explain|what does|list the)\b"
HARD_INTENT = r"\b(refactor|migrat|redesign|architect|across (the )?(codebase|services|modules))\b"
COMPLETION = r"\b(that'?s done|great,? now|perfect,? now|ok(ay)? now|next,? (let'?s|please))\b"
EPISODE_COMPLETION = r"\b(?:that(?:'s| is) done|done with (?:that|this)|(?:we(?:'re| are) )?finished|task (?:is )?complete|great[,;:]?\s+(?:now|next)|new task|next task)\b"
FILE_REFERENCE = r"(?iU)((?<![\w.-])(?:[\w.-]+/)+[\w.-]+|(?<![\w.-])[\w.-]+\.(?:py|js|ts|tsx|jsx|go|rs|java|kt|swift|rb|php|md|yaml|yml|toml|json|sql)(?![\w.-]))"
QUESTION_WORDS = "what why how when where who which can could should would is are do does did will any anything".split()
DISFLUENCY = "uh um umm uhh erm hmm hm eh err uhm".split()
TXT_SPEAK = """u ur r y k kk thx plz pls pln btw imo imho idk tbh asap rn ppl msg cuz cus coz gonna wanna dunno lemme gimme kinda
sorta outta gotta hafta yea yeah yep nope nvm smth b4 l8r w/ w/o abt def prob prolly obv tho afaik fyi wtf omg lol ok okay""".split()
NO_APOSTROPHE = """dont cant wont isnt arent wasnt werent didnt doesnt couldnt shouldnt wouldnt hasnt havent hadnt im ive id ill
youre youve youd theyre theyve thats whats lets its wont aint gimme""".split()
VERBS = """is are was were be been being am has have had do does did add adds added fix fixes fixed change changed make made
makes run runs ran running create created write wrote update updated remove removed delete deleted move moved rename renamed
refactor refactored check checked review reviewed use used build built set sets get gets got put show shows showed tell give
gave explain explained implement implemented test tested push pushed pushes commit committed merge merged revert reverted can
could should would will lets let need needs want wants try tried trying see seeing look looking go going does open close start
stop keep help handle wrap ensure verify confirm skip drop call calls install pull rebase deploy generate parse print return
send read load save split join replace apply revert refactor rework wire hook mock""".split()
POLL = "status done pushed ready yet now finished update progress eta stuck working".split()
APPROVAL = "go ahead do it yes yep sure ok okay proceed try again continue ship send approved".split()
STOP_WORDS = """the a an and or of to in on for is are be it this that with as at by from i you we they he she can could should
would will do does did please""".split()
ARCHETYPES = ["disfluent-runon", "long-plan-paste", "path-paste", "terse-poll", "approval-nudge", "question", "coding-ask"]
TERMINAL = "[.!?…]"
SECRET_HIGH = [
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer_token", r"\b(?:sk-ant-[a-zA-Z0-9_-]{20,}|sk-[a-zA-Z0-9]{32,}|ghp_[a-zA-Z0-9]{36}|gho_[a-zA-Z0-9]{36}|xox[bp]-[a-zA-Z0-9-]{20,})"),
]
ENV_ASSIGNMENT = r"\b[A-Z][A-Z0-9]*_?(?:API_?KEY|SECRET(?:_?KEY)?|PASSWORD|PASSWD|ACCESS_?KEY|AUTH_?TOKEN|PRIVATE_?KEY|CLIENT_?SECRET)[A-Z0-9_]*\s*[=:]\s*['\"]?([A-Za-z0-9+/=_-]{16,})['\"]?"
CONNECTION = r"\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s/:@]+:([^\s@]+)@([^\s/:]+)"
PLACEHOLDER_VALUES = """pass password passwd changeme secret example test user username foo bar xxx your_password placeholder admin
root 123456 postgres mysql redis""".split()
PLACEHOLDER_HOSTS = "localhost 127.0.0.1 example.com host db database".split()
ENTROPY_LEAST, VALUE_LEAST = 3.0, 12
# ---------------------------------------------------------------------------------------------------------------------


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike("(?iU)" + pattern)


def first_of(c: Column, classes: list[tuple], default) -> Column:
    """The value of the first class whose pattern matches."""
    return reduce(lambda rest, x: F.when(matches(c, x[-1]), F.lit(x[0])).otherwise(rest), reversed(classes), F.lit(default))


def verb_class(text: Column) -> Column:
    return first_of(strip(text_of(text)), VERB_CLASSES, "unknown")


def verb_score(text: Column) -> Column:
    return first_of(strip(text_of(text)), [(s, p) for _, s, p in VERB_CLASSES], UNKNOWN_SCORE).cast("double")


def corpus_intent(text: Column) -> Column:
    return first_of(strip(text_of(text)), CORPUS_INTENTS, "other")


def intent_score(base: Column, broad: Column, narrow: Column, context_tokens: Column) -> Column:
    """Base score, broad +0.2, narrow -0.1, over 20,000 tokens of context +0.1, kept within 0 and 1."""
    s = base + F.when(broad, 0.20).otherwise(0.0) - F.when(narrow, 0.10).otherwise(0.0) + F.when(context_tokens > 20_000, 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def heuristic_score(intent: Column, edit_failures: Column, errors: Column, interrupted: Column) -> Column:
    """The intent score and what the session's last turns add, kept within 0 and 1 once more."""
    s = intent + F.when(edit_failures >= 1, 0.15).otherwise(0.0) + F.when(errors >= 3, 0.10).otherwise(0.0) + F.when(interrupted, 0.30).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def words(text: Column) -> Column:
    return F.filter(F.split(text_of(text), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words in lower case without punctuation at either end; a word of punctuation only is an empty token."""
    return F.transform(words(text), lambda w: F.lower(F.btrim(w, F.lit(".,!?:;()[]\"'"))))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def any_of(found: Column, vocabulary: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, dict.fromkeys(vocabulary))))


def all_lowercase(text: Column) -> Column:
    t = text_of(text)
    return t.rlike(r"\p{L}") & (t == F.lower(t))


def no_terminal_punct(text: Column) -> Column:
    t = F.regexp_replace(text_of(text), r"(?U)\s+$", "")
    return (t != "") & ~t.rlike(TERMINAL + "$")


def is_question(text: Column) -> Column:
    return F.contains(text_of(text), F.lit("?")) | F.coalesce(F.get(tokens(text), F.lit(0)).isin(*QUESTION_WORDS), F.lit(False))


def has_path(text: Column) -> Column:
    t = text_of(text)
    return t.rlike(r"(/Users/|/home/|~/|[A-Za-z]:\\)") | t.rlike(r"(?U)(/[\w.\-]+){2,}")


def has_fence(text: Column) -> Column:
    return F.contains(text_of(text), F.lit("```"))


def has_emoji(text: Column) -> Column:
    return text_of(text).rlike(r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}\x{1f000}-\x{1f0ff}]")


def has_disfluency(text: Column) -> Column:
    return any_of(tokens(text), DISFLUENCY)


def is_txt_speak(text: Column) -> Column:
    t = text_of(text)
    return any_of(tokens(text), TXT_SPEAK + NO_APOSTROPHE) | F.lower(t).rlike(r"([a-z])\1{2,}") | F.contains(t, F.lit("!!")) | F.contains(t, F.lit("??"))


def is_verbless(text: Column) -> Column:
    return ~any_of(tokens(text), VERBS)


def archetype(text: Column) -> Column:
    """One of seven classes; the order is part of the definition."""
    n, found, asks = word_count(text), tokens(text), is_question(text)
    approves = any_of(found, APPROVAL)
    return (
        F.when(has_disfluency(text) & (n >= 8), "disfluent-runon")
        .when(n >= 50, "long-plan-paste")
        .when(has_path(text), "path-paste")
        .when((n <= 3) & (any_of(found, POLL) | asks), "terse-poll")
        .when((n <= 3) & approves, "approval-nudge")
        .when(n <= 3, "terse-poll")
        .when((n <= 6) & approves & ~asks, "approval-nudge")
        .when(asks, "question")
        .otherwise("coding-ask")
    )


def content_words(text: Column) -> Column:
    """Distinct tokens of two letters or more that are not function words."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def file_references(text: Column) -> Column:
    """Paths and file names, lower-cased, distinct and sorted."""
    found = F.regexp_extract_all(text_of(text), F.lit(FILE_REFERENCE), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for an empty value."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(F.length(value) > 0, bits).otherwise(0.0)


def secret_hits(text: Column) -> Column:
    """Names of the secret patterns in a text, in order; matched values are not kept."""
    t = text_of(text)
    strong = lambda v: (F.length(v) >= VALUE_LEAST) & (shannon_entropy(v) >= ENTROPY_LEAST)
    env = F.exists(F.regexp_extract_all(t, F.lit(ENV_ASSIGNMENT), F.lit(1)), strong)
    values, hosts = (F.regexp_extract_all(t, F.lit(CONNECTION), F.lit(i)) for i in (1, 2))
    real = F.zip_with(values, hosts, lambda v, h: ~F.lower(v).isin(*PLACEHOLDER_VALUES) & ~F.lower(h).isin(*PLACEHOLDER_HOSTS) & strong(v))
    found = [F.when(t.rlike(p), F.lit(name)) for name, p in SECRET_HIGH]
    found += [F.when(env, F.lit("env_assignment")), F.when(F.exists(real, lambda x: x), F.lit("connection_string_cred"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def secret_hits_nested(leaves: Column) -> Column:
    """Over an array of string leaves: each name once, in order of first appearance."""
    return F.array_distinct(F.flatten(F.transform(leaves, secret_hits)))


def version_bucket(version: Column) -> Column:
    """a.b.x of a version of three parts or more; the version itself otherwise; unknown if there is none."""
    parts = F.split(version, r"\.")
    return F.when(version.isNull(), "unknown").when(F.size(parts) < 3, version).otherwise(F.concat(parts[0], F.lit("."), parts[1], F.lit(".x")))


def glob_match(path: Column, pattern: str) -> Column:
    """A shell pattern as a regular expression."""
    import fnmatch

    return path.rlike("^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + "$")


def is_test_path(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.exists(F.split(path, "/"), lambda p: p.isin("test", "tests")) | name.startswith("test_") | name.rlike(r"_test\.[^.]+$") | name.rlike(r"\.(test|spec)\.[^.]+$")


def regex_uncertain(verb: Column, score: Column) -> Column:
    """Verdicts the regular expressions leave open; both bounds belong to the band."""
    return (verb == "unknown") | score.between(0.35, 0.70)


TIERS = ("trivial", "standard", "hard")


def parse_verdict(content: Column, derive: bool = True) -> Column:
    """STRUCT<tier, needs_frontier> from a model's answer, leniently: a JSON block first, then the bare words.

    derive: needs_frontier follows the tier; otherwise it is what the answer says, null if it says nothing. A tier other
    than trivial, standard and hard is null.
    """
    block = F.regexp_extract(text_of(content), r"(?s)(\{.*?\})", 1)
    tier = F.lower(F.coalesce(F.nullif(F.get_json_object(block, "$.tier"), F.lit("")), F.nullif(F.regexp_extract(text_of(content), r"(?i)\b(trivial|standard|hard)\b", 1), F.lit(""))))
    tier = F.when(tier.isin(*TIERS), tier)
    said = F.lower(F.coalesce(F.get_json_object(block, "$.needs_frontier"), F.nullif(F.regexp_extract(text_of(content), r"(?i)needs_frontier\W+(true|false)", 1), F.lit(""))))
    return F.struct(tier.alias("tier"), ((tier == "hard") if derive else F.when(said.isin("true", "false"), said == "true")).alias("needs_frontier"))


#: What an embedder wants before a text that is stored, and before one that is looked up.
STORED, LOOKED_UP = "search_document: ", "search_query: "


def for_embedding(text: Column, query: bool = False) -> Column:
    """The text as an embedder wants it; null stays null."""
    return F.concat(F.lit(LOOKED_UP if query else STORED), text)
