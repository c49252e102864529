"""What a study is, from its title, abstract and metadata: role, design, tier, directness, lane and outcome.

All rules are decision lists of built-in regular expressions, one projection for any
number of them. Lists of markers are arguments with defaults that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import any_of

# Markers of roles and designs.
REVIEW_MARKERS = ("systematic review", "meta-analysis", "meta analysis", "umbrella review", "narrative review", "scoping review", "literature review")
META_MARKERS = ("meta-analysis", "meta analysis")
PROTOCOL_MARKERS = (
    "study protocol", "trial protocol", "is a protocol", "rationale and design", "study design and rationale", "design of a randomized", "design of a randomised", "design of an open-label",
    "study to evaluate", "study evaluates the safety and efficacy", "evaluates the safety and efficacy", "trial investigating", "trial designed to", "this study examines whether", "we will assess", "we will evaluate", "we will examine",
    "study will assess", "study will evaluate", "study will examine", "study will test", "this study aims to", "study is to assess", "study is to evaluate", "study is to determine",
)
RANDOMIZED = r"(?i)\b(randomi[sz]ed|rct|double[-\s]blind|placebo[-\s]controlled)\b"
REPORTED = (
    r"(?i)(\bp\s*[=<>]\s*0?\.\d+|95\s*%\s*ci|\bhazard\s+ratio|\bodds\s+ratio|\brisk\s+ratio|\bhr\s*=?\s*\d|\bor\s*=?\s*\d|\brr\s*=?\s*\d"
    r"|(?:reduced|increased|improved|decreased|lowered|raised|declined|reversed|attenuated)\s+(?:by\s+)?\d+(?:\.\d+)?\s*%|\bmean\s+(?:difference|change|reduction|increase)|\b(?:participants|patients|subjects|adults)\s+\(\s*n\s*=\s*\d{2,}\s*\))"
)
TRIAL_DESIGN = (
    r"(?i)(?:first|pivotal|seminal)\s+clinical\s+trial|phase\s+(?:i{1,3}|1|2|3|iv|4)\b|open[-\s]label\s+(?:trial|study|phase|pilot)|(?:double|single)[-\s]blind\s+(?:randomi[sz]ed|trial|placebo)"
    r"|placebo[-\s]controlled\s+(?:trial|study|pilot|phase)|we\s+(?:randomi[sz]ed|administered|treated|assigned)\s+\w+|in\s+this\s+(?:open[-\s]label|double[-\s]blind|randomi[sz]ed|placebo[-\s]controlled|pilot)\s+"
)
QUALITATIVE = r"(?i)\b(?:improved|reduced|decreased|increased|enhanced|attenuated|reversed|lowered|raised|cleared|eliminated|prolonged)\s+\w+"
ANIMAL = r"(?i)\b(mice|mouse|rats?|murine|canine|porcine|bovine|zebrafish|drosophila|c\.\s*elegans|monkeys?|primates?|cynomolgus|macaque|baboon|marmoset|non[-\s]human\s+primate)\b"
CELL = r"(?i)\b(in[-\s]vitro|cell\s+(line|culture)|primary\s+cells|ex\s+vivo)\b"
PEDIATRIC = r"(?i)\b(pediatric|paediatric|children|adolescen[ct]|infants?|neonatal)\b"
HUMAN_TRIAL = (
    r"(?i)\b(?:we\s+(?:randomi[sz]ed|enrolled|recruited|randomly\s+assigned)|(?:older|elderly|adult|aged)\s+(?:adults|men|women|patients|participants|subjects)|patients\s+(?:were\s+)?(?:randomi[sz]ed|enrolled|recruited)"
    r"|participants\s*\(\s*n\s*=\s*\d{2,}|men\s+and\s+women|male\s+and\s+female\s+(?:patients|participants)|n\s*=\s*\d{2,}\s+(?:patients|participants|subjects|adults|older)|in\s+(?:patients|participants|subjects|adults|older\s+adults)\s+with"
    r"|in\s+a\s+(?:randomi[sz]ed|placebo[-\s]controlled|double[-\s]blind)\s+trial\s+(?:of|in)\s+(?:patients|adults|participants))\b"
)
AGING_TITLE = (
    r"(?i)\b(?:longevity|aging|ageing|older|elderly|geriatric|frailty|sarcopen[a-z]+|healthspan|lifespan|epigenetic\s+(?:age|clock)|senescen[a-z]+|geroscience|cognitive[-\s](?:decline|aging|impairment)|brain[-\s]aging|mortality|survival"
    r"|biological\s+age|aging[-\s]related|age[-\s]related|geroprotective|gerotherapeutic|hallmarks?\s+of\s+aging|physical\s+(?:function|performance)|gait\s+speed|walk\s+speed|grip\s+strength|(?:adult|men|women|patients|participants)\s+aged|aged\s+\d{2,})\b"
)
HIGH_IMPACT = ("new england journal of medicine", "lancet", "jama", "bmj", "nature medicine", "cell", "nature", "science", "annals of internal medicine")
HUMAN_DOMAINS = ("human", "longevity", "aging", "ageing", "older adult", "adult", "patient", "clinical")
ADULT_DOMAINS = ("adult", "older", "elderly", "geriatric")
AGING_DOMAINS = ("aging", "ageing", "longevity", "older", "elderly", "geriatric", "healthspan", "lifespan", "geroscience")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def study_role(source: Column, title: Column, abstract: Column, has_results: Column) -> Column:
    """A registry entry by its results; else review, protocol without a reported outcome, results, or mechanistic."""
    low = F.lower(F.concat_ws(" ", title, abstract))
    reported = _text(abstract).rlike(REPORTED)
    return (
        F.when(source == "clinicaltrials", F.when(F.coalesce(has_results, F.lit(False)), "published_results").otherwise("registered_pending"))
        .when(any_of(low, list(REVIEW_MARKERS)), "review")
        .when(any_of(low, list(PROTOCOL_MARKERS)) & ~reported, "published_protocol")
        .when(reported | (_text(abstract).rlike(TRIAL_DESIGN) & _text(abstract).rlike(QUALITATIVE)), "published_results")
        .otherwise("mechanistic")
    )


def study_design(role: Column, abstract: Column) -> Column:
    return (
        F.when(role == "published_results", F.when(_text(abstract).rlike(RANDOMIZED), "rct").otherwise("observational"))
        .when(role == "review", F.when(any_of(F.lower(_text(abstract)), list(META_MARKERS)), "meta_analysis").otherwise("review"))
        .when(role == "published_protocol", "protocol").when(role == "registered_pending", "registry").when(role == "mechanistic", "mechanistic").otherwise("other")
    )


def evidence_tier(role: Column, design: Column, venue: Column) -> Column:
    high = any_of(F.lower(_text(venue)), list(HIGH_IMPACT))
    return (
        F.when(design.isin("rct", "meta_analysis"), F.when(high, "A1").otherwise("A2")).when(role.isin("published_results", "review"), "A2")
        .when(role.isin("published_protocol", "registered_pending"), "B").otherwise("C")
    )


def is_direct(title: Column, abstract: Column, domain: str, anchors: list[str]) -> Column:
    """Topic and population fit of a domain; explicit human signals outweigh animal and cell words."""
    has = lambda markers: any(m in domain for m in markers)
    body, ok = _text(abstract), F.lit(True)
    if has(HUMAN_DOMAINS):
        ok = ok & ~(~body.rlike(HUMAN_TRIAL) & (body.rlike(ANIMAL) | body.rlike(CELL)))
    if has(ADULT_DOMAINS):
        ok = ok & ~body.rlike(PEDIATRIC)
    if anchors:
        ok = ok & F.lower(F.concat_ws(" ", title, abstract)).rlike(r"\b(?:" + "|".join(anchors) + r")\b")
    if has(AGING_DOMAINS):
        ok = ok & _text(title).rlike(AGING_TITLE)
    return ok


def is_strict(direct: Column, year: Column, min_year: int | None) -> Column:
    """Direct and recent enough; an unknown year passes."""
    return direct & (F.lit(True) if min_year is None else F.coalesce(year >= min_year, F.lit(True)))


def bias_label(role: Column) -> Column:
    return F.when(role.isin("published_results", "review"), "not assessed").when(role.isin("registered_pending", "published_protocol"), "n/a (no results)").otherwise("n/a (preclinical)")


def confidence(items: DataFrame, by: str) -> DataFrame:
    """(by, trials, meta, results, pending, verdict) of items(by, role, design, tier, direct): direct evidence decides."""
    d, role = F.col("direct"), F.col("role")
    counts = items.groupBy(by).agg(
        F.count_if(d & (role == "published_results") & (F.col("design") == "rct") & F.col("tier").isin("A1", "A2")).alias("trials"), F.count_if(d & (role == "review") & (F.col("design") == "meta_analysis")).alias("meta"),
        F.count_if(d & (role == "published_results")).alias("results"), F.count_if(d & role.isin("registered_pending", "published_protocol")).alias("pending"),
    )
    return counts.withColumn("verdict", F.when(F.col("trials") + F.col("meta") > 0, "moderate").when(F.col("results") + F.col("pending") > 0, "low").otherwise("very low"))


# Words of species and designs.
HUMAN_WORDS = ("human", "humans", "homo sapiens", "men", "women", "older adults", "adults", "elderly", "patients", "people", "participants", "children")
ANIMAL_WORDS = (
    "mouse", "mice", "murine", "rat", "rats", "rodent", "rodents", "c. elegans", "c elegans", "nematode", "nematodes", "worm", "worms", "yeast", "drosophila", "fly", "flies", "zebrafish", "monkey", "monkeys", "macaque", "macaques", "baboon", "baboons",
    "non-human primate", "nonhuman primate", "marmoset", "marmosets", "dog", "dogs", "rabbit", "rabbits", "hamster", "hamsters", "guinea pig", "fox", "foxes", "vulpes", "broiler", "broilers", "chicken", "chickens", "poultry", "fowl", "avian",
    "cow", "cows", "cattle", "bovine", "pig", "pigs", "piglet", "piglets", "porcine", "swine", "sheep", "ovine", "goat", "goats", "caprine", "horse", "horses", "equine",
)
PROTOCOL_DESIGNS = ("study protocol", "trial protocol", "research protocol", "protocol for a", "protocol for the", "rationale and design", "design and rationale", "rationale and study design", "statistical analysis plan")
REVIEW_DESIGNS = ("systematic review", "meta-analysis", "meta analysis", "narrative review", "scoping review", "umbrella review", "literature review")
RCT_DESIGNS = (
    "randomized controlled trial", "randomised controlled trial", "randomized clinical trial", "randomised clinical trial", "randomized trial", "randomised trial",
    "double-blind", "double blind", "placebo-controlled", "placebo controlled", "rct", "randomized", "randomised",
)
OBSERVED_DESIGNS = (
    "target trial emulation", "registry-based", "registry analysis", "prospective cohort", "retrospective cohort", "ehr cohort", "cohort study", "cohort", "case-control", "case control",
    "observational", "retrospective", "prospective", "case report", "case series", "case-by-case",
)
PRECLINICAL_DESIGNS = ("animal study", "preclinical", "in vivo", "in vitro", "cell culture", "cell line", "molecular study", "biochemical")
NOT_RANDOMIZED = r"(?i)\b(?:single[\-\s]?(?:arm|group)|(?:non|pseudo|quasi)[\-\s]?randomi[sz]ed|observational|retrospective|case reports?|case series|case[\-\s]by[\-\s]case)\b"
FUTURE_TRIAL = r"(?i)\b(?:trials?\s+(?:are|is)\s+(?:needed|required|warranted)|(?:need(?:ed)?|requires?|warrants?|future)\b[^.!?]*\btrials?|trials?\s+to\s+(?:confirm|test))\b"
TITLE_PROTOCOL = (
    r"(?i)\b(study protocol|trial protocol|research protocol|protocol (?:for|of)(?: (?:a|an|the))?|rationale and design|design and rationale|rationale and study design|statistical analysis plan|baseline characteristics and design|design and baseline (?:data|characteristics))\b"
)
TITLE_RCT = r"(?i)\b(randomi[sz]ed|randomly assigned|RCT|placebo[\-\s]?controlled|double[\-\s]?blind)\b"
TITLE_OBSERVED = r"(?i)\b(cohort|registry|observational|target trial|emulation|retrospective|prospective|case[\-\s]?control|case reports?|case series|case[\-\s]by[\-\s]case|single[\-\s]?(?:arm|group)|(?:non|pseudo|quasi)[\-\s]?randomi[sz]ed)\b"
TITLE_REVIEW = r"(?i)\b(systematic review|meta[\-\s]?analys(?:is|es)|narrative review|scoping review|critical review|umbrella review|literature review|pooled analysis|review of)\b"
TITLE_PRECLINICAL = r"(?i)\b(in vitro|in vivo|preclinical|cell culture|molecular|mechanistic|mechanism|biochemical)\b"
TITLE_ANIMAL = r"(?i)\b(mouse|mice|rat|rats|c\.?\s*elegans|drosophila|yeast|primate|marmoset|zebrafish|fish|bass|nematode|worm)\b"
TITLE_HUMAN = r"(?i)\b(human|patients|adults|older adults|men|women|elderly|males|females|participants|subjects)\b"
ENDPOINT_KINDS = {
    "mortality": r"(?i)\b(mortality|all[\-\s]?cause death|survival|lifespan|longevity)\b",
    "functional": r"(?i)\b(walk speed|grip strength|frailty|physical performance|VO2 ?max|sarcopenia|functional)\b",
    "mechanistic": r"(?i)\b(mechanism|pathway|signaling|expression|biomarker|protein|gene)\b",
}
DIRECT_ENDPOINTS = ("clinical", "functional", "mortality", "longevity", "surrogate")


def _as_words(words: tuple[str, ...]) -> str:
    """A pattern of any of the words between characters that are not letters."""
    ordered = sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True)
    return r"(?i)(?:^|[^a-z])(?:" + "|".join(ordered) + r")(?:[^a-z]|$)"


HUMAN_TEXT, ANIMAL_TEXT = _as_words(HUMAN_WORDS), _as_words(ANIMAL_WORDS)


def population(text: Column) -> Column:
    """human, animal or unknown; human words win."""
    low = F.lower(_text(text))
    return F.when(low.rlike(HUMAN_TEXT), "human").when(low.rlike(ANIMAL_TEXT), "animal").otherwise("unknown")


def design_class(design: Column) -> Column:
    """protocol, review, observational, rct, preclinical or unknown: the first that fits."""
    low = F.lower(F.trim(_text(design)))
    return (
        F.when(any_of(low, list(PROTOCOL_DESIGNS)), "protocol").when(any_of(low, list(REVIEW_DESIGNS)), "review").when(low.rlike(NOT_RANDOMIZED), "observational")
        .when(any_of(low, list(RCT_DESIGNS)), "rct").when(any_of(low, list(OBSERVED_DESIGNS)), "observational").when(any_of(low, list(PRECLINICAL_DESIGNS)), "preclinical").otherwise("unknown")
    )


def _says(tier: str, directness: str) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(directness).alias("directness"))


def with_class(rows: DataFrame, design: Column, species: Column, endpoint: Column, into: str = "c") -> DataFrame:
    """Adds design_class and struct(tier, directness) of a design text, a species and a kind of endpoint.

    What a decision uses more than once is a column first, so that it is made once.
    """
    kind, human, animal, sp = (F.col(c) for c in ("design_class", "_human", "_animal", "_sp"))
    made = rows.withColumns({"design_class": design_class(design), "_sp": F.lower(F.trim(_text(species))), "_ep": F.lower(F.trim(_text(endpoint)))})
    made = made.withColumns({"_human": any_of(sp, list(HUMAN_WORDS)), "_animal": any_of(sp, list(ANIMAL_WORDS))})
    decision = (
        F.when(kind == "protocol", _says("D1", "protocol"))
        .when((kind == "rct") & human & (F.col("_ep") == "mechanistic"), _says("A2", "indirect"))
        .when((kind == "rct") & human, _says("A1", "direct"))
        .when(kind == "review", _says("B1", "review"))
        .when((kind == "observational") & human, _says("B2", "indirect"))
        .when((kind == "preclinical") | animal, _says("C1", "mechanistic"))
        .when((kind == "unknown") & (sp != "") & ~human, _says("C2", "review"))
        .otherwise(_says("unknown", "unknown"))
    )
    return made.withColumn(into, decision).drop("_sp", "_ep", "_human", "_animal")


def _plain(c: Column) -> Column:
    return F.regexp_replace(_text(c), "[\u00ad\u2010-\u2015\u2212]", "-")


def is_protocol(title: Column, abstract: Column) -> Column:
    """A paper that announces a study: by its title, or by a design title and a plan in the abstract."""
    return (
        title.rlike(TITLE_PROTOCOL)
        | (title.rlike(r"(?i)\bstudy design\s*$") & abstract.rlike(r"(?i)\b(?:trial|study) is designed to\b"))
        | (title.rlike(r"(?i)\bdesign of\b[^.!?]*\b(?:trials?|studies|study)\b") & abstract.rlike(r"(?i)\b(?:completion\b[^.!?]{0,70}\bexpected|trials? will (?:provide|evaluate)|anticipated \d+ (?:patients|participants))\b"))
        | abstract.rlike(r"(?i)\b(?:results?|findings) (?:from|of) this protocol (?:are|is) expected\b")
    )


def with_trial(rows: DataFrame, title: Column, abstract: Column, design: Column | None = None) -> DataFrame:
    """Adds protocol and primary_trial.

    A primary trial is a randomised study of its own: no protocol, review or other
    design by title, and randomised by title, or by sentences of its methods that do
    not call for future trials.
    """
    methods = r"(?is)\bmethods?\s*:\s*(.*?)(?:\b(?:results?|conclusions?|discussion)\s*:|$)"
    made = rows.withColumns({"_title": _plain(title), "_abstract": _plain(abstract), "_design": _plain(design if design is not None else F.lit(""))})
    t, a, d = (F.col(c) for c in ("_title", "_abstract", "_design"))
    own = F.when(a.rlike(methods), F.regexp_extract(a, methods, 1)).otherwise(a)
    told = F.array_join(F.filter(F.split(own, r"[.!?]\s+"), lambda s: ~s.rlike(FUTURE_TRIAL) & ~s.rlike(NOT_RANDOMIZED)), " ")
    made = made.withColumns({"protocol": is_protocol(t, a), "_identity": F.concat_ws(" ", t, d), "_said": told})
    identity = F.col("_identity")
    primary = (
        ~F.col("protocol") & ~d.rlike(TITLE_PROTOCOL) & ~identity.rlike(TITLE_REVIEW) & ~identity.rlike(NOT_RANDOMIZED)
        & (identity.rlike(TITLE_RCT) | (F.col("_said").rlike(TITLE_RCT) & ~a.rlike(TITLE_REVIEW)))
    )
    return made.withColumn("primary_trial", primary).drop("_title", "_abstract", "_design", "_identity", "_said")


def with_inferred(rows: DataFrame, title: Column, abstract: Column, into: str = "c") -> DataFrame:
    """Adds struct(tier, directness) by what title and abstract say, where there is no metadata."""
    made = with_trial(rows, title, abstract).withColumn("_both", F.concat_ws(" ", _plain(title), _plain(abstract)))
    both = F.col("_both")
    design = (
        F.when(F.col("protocol"), "study protocol").when(both.rlike(TITLE_REVIEW), "systematic review").when(F.col("primary_trial"), "randomized controlled trial")
        .when(both.rlike(TITLE_OBSERVED), "cohort").when(both.rlike(TITLE_PRECLINICAL), "preclinical").otherwise("")
    )
    species = F.when(both.rlike(TITLE_ANIMAL), "mouse").when(both.rlike(TITLE_HUMAN), "human").otherwise("")
    endpoint = F.lit("")
    for k, p in reversed(ENDPOINT_KINDS.items()):
        endpoint = F.when(both.rlike(p), k).otherwise(endpoint)
    made = made.withColumns({"_t_design": design, "_t_species": species, "_t_endpoint": endpoint})
    return with_class(made, F.col("_t_design"), F.col("_t_species"), F.col("_t_endpoint"), into).drop("_both", "_t_design", "_t_species", "_t_endpoint", "design_class", "protocol", "primary_trial")


def with_paper_tier(rows: DataFrame, title: Column, abstract: Column, design: Column, species: Column, endpoint: Column, canonical: Column, into: str = "c") -> DataFrame:
    """Adds struct(tier, directness) of a paper: a protocol, a primary trial, explicit metadata, what
    the text says, and, where none decides, a canonical trial or an indirect study."""
    made = with_trial(with_class(with_inferred(rows, title, abstract, "_told"), design, species, endpoint, "_stated"), title, abstract, design)
    given = F.coalesce(*[F.nullif(_text(c), F.lit("")) for c in (design, species, endpoint)]).isNotNull()
    made = made.withColumn("_found", F.when(given, F.col("_stated")).otherwise(F.col("_told")))
    decision = (
        F.when(F.col("_told.directness") == "protocol", F.col("_told")).when(F.col("primary_trial"), _says("A1", "direct"))
        .when(F.col("_found.tier") != "unknown", F.col("_found")).when(canonical, _says("A1", "direct")).otherwise(_says("B2", "indirect"))
    )
    return made.withColumn(into, decision).drop("_told", "_stated", "_found", "design_class", "protocol", "primary_trial")


# Words of animal papers and of human identity, for lanes.
ANIMAL_PAPER = (
    r"(?i)\b(mice|murine|mouse|rats?|rodents?|equids?|equine|horses?|primates?|monkeys?|macaques?|baboons?|marmosets?|dogs?|canine|cats?|feline|rabbits?|hamsters?|swine|porcine|piglets?|pigs?"
    r"|sheep|ovine|goats?|caprine|cattle|bovine|foxe?s?|vulpes|broilers?|chickens?|poultry|fowl|avian|zebrafish|c\.\s*elegans|drosophila|yeast|nematodes?|veterinary|preclinical|animal\s+model)\b"
)
HUMAN_IDENTITY = r"(?i)\b(?:humans?|people|adults|men|women|human\s+(?:patients?|participants?|subjects?))\b"
TRIAL_IDENTITY = r"(?i)\brandomi[sz]ed(?:\s+controlled)?\s+clinical\s+trial\b"
IN_HUMANS = r"(?i)\bin (?:healthy |older |younger )?humans?\b"


def lane(tier: Column, directness: Column, title: Column, venue: Column, population_: Column, excerpt: Column) -> Column:
    """One of six lanes; a human trial outranks animals that its excerpt mentions."""
    tier, directness = F.upper(_text(tier)), F.lower(_text(directness))
    identity = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(venue, F.lit("")), F.nullif(population_, F.lit("")))
    animal, mentioned = identity.rlike(ANIMAL_PAPER), _text(excerpt).rlike(ANIMAL_PAPER)
    human = identity.rlike(HUMAN_IDENTITY) & (identity.rlike(HUMAN_TRIAL) | identity.rlike(TRIAL_IDENTITY) | _text(title).rlike(IN_HUMANS))
    return (
        F.when((directness == "review") | (tier == "B1"), "review_meta_analysis")
        .when((tier == "A1") & ~animal & (~mentioned | human), "human_rct")
        .when(animal | (mentioned & ~human), "animal_preclinical")
        .when(directness == "mechanistic", "human_mechanistic").when(tier.isin("A2", "B2"), "human_observational").when(tier == "C", "animal_preclinical").otherwise("background_only")
    )


def effective_directness(directness: Column, lane_: Column) -> Column:
    """Direct evidence from animals is indirect."""
    low = F.lower(F.coalesce(F.nullif(directness, F.lit("")), F.lit("indirect")))
    return F.when((low == "direct") & (lane_ == "animal_preclinical"), "indirect").otherwise(low)


# Endpoints and texts that name an outcome class.
ENDPOINT_NAMES = {
    "healthspan_qol": (
        "emotional well-being", "psychological well-being", "general health", "self-reported health", "self-reported pain",
        "pain score", "quality of life", "qol", "sf-36", "sf36", "vitality",
    ),
}
ENDPOINT_PATTERNS = (
    (r"\bemotional\s+well[-\s]?being\b", "healthspan_qol"),
    (r"\bpsychological\s+well[-\s]?being\b", "healthspan_qol"),
    (r"\bself[-\s]?reported\s+(?:pain|health|well[-\s]?being)\b", "healthspan_qol"),
    (r"\bquality\s+of\s+life\b", "healthspan_qol"),
    (r"\bsf[-\s]?36\b", "healthspan_qol"),
    (r"\bgeneral\s+health\b", "healthspan_qol"),
    (r"\bvitality\s+scale\b", "healthspan_qol"),
    (r"\bpatient[-\s]?reported\s+outcome\b", "healthspan_qol"),
    (r"\b(?:inspiratory muscle|pulmonary function|lung function|vital capacity|minute ventilation|tidal volume|aerobic capacity|(?:maximal|maximum) oxygen uptake|ventilation threshold)\b", "contextual_other"),
)
SOURCE_CLASS = {
    "cardiometabolic": r"\b(?:pregnan\w*|pre[-\s]?eclampsia|gestational\s+hypertension|hypertensive\s+disorders?\s+of\s+pregnancy|cardiovascular|cvd|ischemic\s+stroke|stroke|blood\s+pressure|hypertension|hypertensive|type\s+2\s+diabetes|diabetes|insulin|glucose|body\s+weight|bmi|overweight|metabolic)\b",
    "safety_comorbidity": r"\b(?:creatinine|kidney)\b",
}
OTHER_CLASS = {
    "deficiency_prevalence": ("deficiency", "insufficiency", "prevalence"), "dosing_pharmacokinetics": ("dose", "dosing", "pharmacokinetic"), "immune_inflammation": ("inflammation", "immune", "immunoregulat", "sepsis", "infection", "cytokine"),
    "mortality_survival": ("mortality", "survival", "death", "cause_specific_death"), "muscle_function": ("muscle", "sarcopenia", "myopathy"), "safety_comorbidity": ("safety", "adverse", "kidney", "chronic", "comorbidity"), "skeletal_fracture_bone": ("bone", "fracture", "osteoporosis", "calcium"),
}
OVERRIDABLE = ("other", "contextual_other", "skeletal_fracture_bone", "dosing_pharmacokinetics")
CLASS_ALIASES = {"immune": "immune_inflammation", "quality_of_life": "healthspan_qol", "adjacent_evidence": "contextual_other", "bone_fracture": "skeletal_fracture_bone", "contextual_adjacent_evidence": "contextual_other", "exposure_dose_adjacent_evidence": "dosing_pharmacokinetics"}


def _first(text: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(patterns.items()):
        out = F.when(text.rlike(p), k).otherwise(out)
    return out


def outcome_key(label: Column) -> Column:
    """A class id of a label or heading: its words but for "and", without a closing "outcomes"."""
    words = F.filter(F.regexp_extract_all(F.lower(_text(label)), F.lit("[a-z0-9]+"), 0), lambda w: w != "and")
    key = F.regexp_replace(F.array_join(words, "_"), "(_?(outcomes?|endpoints?))+$", "")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CLASS_ALIASES.items() for x in p]), key), key)


def remapped_outcome(endpoint: Column, current: Column) -> Column:
    """The class that an endpoint's name decides, else the current one."""
    key = F.regexp_replace(F.lower(F.trim(_text(endpoint))), r"\s+", " ")
    out = current
    for pattern, name in reversed(ENDPOINT_PATTERNS):
        out = F.when(key.rlike(pattern), name).otherwise(out)
    for name, exact in ENDPOINT_NAMES.items():
        out = F.when(key.isin(*exact), name).otherwise(out)
    return out


def refined_outcome(current: Column, text: Column, directness: Column) -> Column:
    """Splits the classes that say little by the source's text and directness."""
    low, kind = F.regexp_replace(F.lower(F.trim(_text(text))), r"\s+", " "), F.lower(_text(directness))
    named = _first(low, SOURCE_CLASS)
    other = F.lit(None).cast("string")
    for k, terms in reversed(OTHER_CLASS.items()):
        other = F.when(any_of(low, list(terms)), k).otherwise(other)
    return (
        F.when((kind == "protocol") & (outcome_key(current) == "contextual_other"), "contextual_other")
        .when(named.isNotNull() & current.isin(*OVERRIDABLE), named)
        .when(current != "other", outcome_key(current))
        .otherwise(F.coalesce(other, F.when(kind == "mechanistic", "mechanism"), F.lit("contextual_other")))
    )


def outcome_token(value: Column, vocabulary: list[str] | None = None) -> Column:
    """A class id in snake case; null if it is none or not in the vocabulary."""
    canon = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    ok = canon.rlike("^[a-z][a-z0-9_]*$")
    return F.when(ok & canon.isin(*vocabulary) if vocabulary else ok, canon)


def distinct_labels(rows: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """(by, labels): each group's labels in order, those of one class once."""
    firsts = rows.groupBy(by, outcome_key(F.col(label)).alias("_k")).agg(F.min(F.struct(order, label)).alias("f"))
    return firsts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s[label]).alias("labels"))


# Ratings, tiers and hints of the screen for risk of bias.
SCREEN_TIERS = ("A1", "A2", "B", "B1", "B2", "C", "C1", "C2", "mixed")
SCREEN_DIRECTNESS = ("direct", "indirect", "mechanistic", "preclinical", "review")
HINTS = {"low": ("low", "low_risk", "low risk"), "high": ("high", "serious", "critical", "high_risk", "high risk"), "some_concerns": ("some_concerns", "moderate", "unclear", "some concerns")}


def bias_screen(tier: Column, directness: Column, design: Column, hint: Column) -> Column:
    """struct(overall, basis, fail_closed): a conservative screen from structured fields."""
    directness, design, hint = (F.lower(F.trim(_text(c))) for c in (directness, design, hint))
    tier = F.when(F.lower(F.trim(_text(tier))) == "mixed", "mixed").otherwise(F.upper(F.trim(_text(tier))))
    says = lambda overall, basis, closed=False: F.struct((overall if isinstance(overall, Column) else F.lit(overall)).alias("overall"), (basis if isinstance(basis, Column) else F.lit(basis)).alias("basis"), F.lit(closed).alias("fail_closed"))
    hinted = F.lit(None).cast("string")
    for level, words in HINTS.items():
        hinted = F.when(hint.isin(*words), level).otherwise(hinted)
    random = F.contains(design, F.lit("rct")) | F.contains(design, F.lit("randomized")) | (tier == "A1")
    return (
        F.when(~tier.isin(*SCREEN_TIERS) | ~directness.isin(*SCREEN_DIRECTNESS), says("high", "missing_or_invalid_tier_or_directness", True))
        .when(hinted.isNotNull(), says(hinted, F.concat(F.lit("explicit_metadata_hint:"), hinted)))
        .when(random & directness.isin("mechanistic", "preclinical"), says("some_concerns", "randomized_or_top_tier_default,mechanistic_preclinical_bias_floor"))
        .when(random, says("low", "randomized_or_top_tier_default"))
        .when(tier.isin("A2", "B1", "B") | (directness == "review"), says("some_concerns", "nonrandomized_or_secondary_evidence_default"))
        .otherwise(says("high", "low_tier_default"))
    )


# Phrases that give a text's direction, in order of precedence.
DIRECTION_PHRASES = {
    "null": ("did not improve", "did not reduce", "did not change", "no significant difference", "comparable risk", r"comparable [^.]{0,40}outcome", r"similar [^.]{0,40}risk", "did not meet statistical significance", "no significant", "null result"),
    "negative": ("blunted", "attenuated", "blunts", "attenuates", "negatively impacts", "interferes with", "decreased", r"reduced [^.]{0,40}adaptation", "did not enhance", "did not improve", "worse", "worsens", "harmed", "impaired"),
    "positive": ("improved", "increased", "enhanced", "augmented", "extended", "preserved", "protected", r"lower [^.]{0,40}risk", r"lower [^.]{0,40}mortality"),
}


def text_direction(text: Column, outcome: Column, p: Column) -> Column:
    """Direction that a text states: null, negative or positive words, else null for p not below 0.05; unclear for mechanisms."""
    low = F.lower(F.regexp_replace(F.trim(F.translate(_text(text), "·–—", ".--")), r"\s+", " "))
    stated = _first(low, {k: "|".join(v) for k, v in DIRECTION_PHRASES.items()})
    weak = (F.regexp_extract(_text(p), r"(?i)\bp\s*([=<>])\s*0?\.(\d+)", 1).isin("=", ">")) & (F.concat(F.lit("0."), F.regexp_extract(_text(p), r"(?i)\bp\s*([=<>])\s*0?\.(\d+)", 2)).cast("double") >= 0.05)
    return F.when(outcome == "mechanism", "unclear").otherwise(F.coalesce(stated, F.when(weak, "null"), F.lit("unclear")))


def trial_id(*texts: Column) -> Column:
    """The first registry number in the texts, in upper case; null if there is none. Of one text, NCT before ISRCTN."""
    found = [F.nullif(F.regexp_extract(_text(t), p, 0), F.lit("")) for t in texts for p in (r"(?i)NCT\d{8}", r"(?i)ISRCTN\d+")]
    return F.upper(F.coalesce(*found))


POPULATIONS = (r"(?i)(?:older|elderly)\s+adults?", r"(?i)adults?\s+(?:aged|≥|>=)\s*\d+", r"(?i)aged\s+\d+\s*[-–to]\s*\d+", r"(?i)postmenopausal", r"(?i)(?:type 2|t2d|t2dm)")


def population_phrase(directness: Column, *texts: Column) -> Column:
    """The first phrase that names a population, of direct evidence alone."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(_text(t), p, 0), F.lit("")) for t in texts for p in POPULATIONS])
    return F.when(directness == "direct", F.coalesce(found, F.lit(""))).otherwise("")
