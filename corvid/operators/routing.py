"""Rule tables and the operators that apply them: question routing and concept tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import legal_reference, space_key

# Patterns of law domains outside the corpus, and of the two inside. The first
# matching rule decides, in the order external, unrelated, article; the two domains decide where
# only one of them matches.
EXTERNAL = [
    r"\bright to information act\b",
    r"\brti act\b",
    r"\bsebi act\b",
    r"\bsecurities and exchange board\b",
    r"\barbitration and conciliation act\b",
    r"\benvironmental protection act\b",
    r"\bprevention of corruption act\b",
    r"\binsolvency and bankruptcy code\b",
    r"\bnational food security act\b",
    r"\bright to education act\b",
    r"\bforeign exchange management act\b",
    r"\bfema\b",
    r"\bminimum wage law\b",
    r"\bcyberbullying law\b",
    r"\bcopyright law\b",
    r"\bindian contract act\b",
    r"\bcontract act\b",
    r"\binformation technology act\b",
    r"\bit act\b",
    r"\bindustrial disputes\b",
    r"\bindustrial dispute act\b",
    r"\bsecurities markets?\b",
    r"\bsebi\b",
]
UNRELATED = [
    r"\bcopyright\b",
    r"\bpatents?\b",
    r"\btrademarks?\b",
    r"\bgeographical indication\b",
    r"\bcompanies act\b",
    r"\bcompany law\b",
    r"\bcorporate law\b",
    r"\bcompetition act\b",
    r"\bcompetition law\b",
    r"\banti[- ]competitive\b",
    r"\babuse of dominance\b",
    r"\binsolvency and bankruptcy\b",
    r"\bincome[- ]tax\b",
    r"\bgoods and services tax\b",
    r"\bgst\b",
    r"\bcustoms law\b",
    r"\bcustoms act\b",
    r"\bforeign exchange\b",
    r"\bminimum wages?\b",
    r"\blabou?r law\b",
    r"\bindustrial disputes?\b",
    r"\bprovident fund\b",
    r"\bmaternity benefits?\b",
    r"\bindian penal code\b",
    r"\bipc\b",
    r"\bbharatiya nyaya sanhita\b",
    r"\bbns\b",
    r"\bcriminal procedure\b",
    r"\bcriminal law\b",
    r"\bcrpc\b",
    r"\bindian evidence act\b",
    r"\bbharatiya sakshya\b",
    r"\benvironmental protection act\b",
    r"\benvironment protection act\b",
    r"\benvironmental law\b",
    r"\benvironment law\b",
    r"\bair act\b",
    r"\bair pollution\b",
    r"\bwater act\b",
    r"\bwater pollution\b",
    r"\bwildlife protection act\b",
    r"\bforest conservation\b",
    r"\binformation technology law\b",
    r"\bcyber law\b",
    r"\bcyber crime\b",
    r"\bcyber offences?\b",
    r"\bdata protection\b",
    r"\bdigital personal data\b",
    r"\bcontract law\b",
    r"\barbitration and conciliation\b",
    r"\barbitration law\b",
    r"\bnegotiable instruments\b",
    r"\bcheque dishonou?r\b",
    r"\bmotor vehicles act\b",
    r"\bpassport act\b",
    r"\btransfer of property act\b",
    r"\bspecific relief act\b",
]
ARTICLE = [r"\barticle\s+\d+[a-z]?\b"]
CONSTITUTION = [
    r"\bconstitution of india\b",
    r"\bconstitutional\b",
    r"\bpreamble\b",
    r"\bfundamental rights?\b",
    r"\bfundamental duties?\b",
    r"\bdirective principles?\b",
    r"\bunion list\b",
    r"\bstate list\b",
    r"\bconcurrent list\b",
    r"\bseventh schedule\b",
    r"\bschedule\s*7\b",
    r"\bforming a new state\b",
    r"\bnew state\b.*\bconstitution\b",
    r"\bpresident's rule\b",
    r"\bpresident rule\b",
    r"\bparliament\b.*\bconstitution\b",
    r"\bhigh court\b.*\bconstitution\b",
    r"\bsupreme court\b.*\bconstitution\b",
]
CONSUMER = [
    r"\bconsumer protection\b",
    r"\bconsumer complaint\b",
    r"\bconsumer rights?\b",
    r"\bconsumer commission\b",
    r"\bdistrict commission\b",
    r"\bstate commission\b",
    r"\bnational commission\b",
    r"\bcentral consumer protection authority\b",
    r"\bccpa\b",
    r"\bmisleading advertisement\b",
    r"\bunfair trade practice\b",
    r"\brestrictive trade practice\b",
    r"\bproduct liability\b",
    r"\bdeficiency in service\b",
    r"\bdefect in goods\b",
    r"\bspurious goods\b",
    r"\bunfair contract\b",
    r"\be-commerce liability\b",
    r"\bconsumer mediation\b",
    r"\bmediation settlement\b",
    r"\bconsumer law\b",
    r"\bcomplainant\b.*\bconsumer\b",
]
RULES = {"external": EXTERNAL, "unrelated": UNRELATED, "article": ARTICLE, "constitution": CONSTITUTION, "consumer": CONSUMER}

# Pattern and name of a concept. Two patterns end inside a word and so match nothing.
CONCEPTS = [
    (r"\bfundamental rights?\b", "Fundamental Rights"),
    (r"\bfundamental duties?\b", "Fundamental Duties"),
    (r"\bdirective principles?\b", "Directive Principles of State Policy"),
    (r"\bpreamble\b", "Preamble"),
    (r"\bsupreme court\b", "Supreme Court"),
    (r"\bhigh court\b", "High Court"),
    (r"\bparliament\b", "Parliament"),
    (r"\bpresident\b", "President"),
    (r"\bgovernor\b", "Governor"),
    (r"\bprime minister\b", "Prime Minister"),
    (r"\belection commission\b", "Election Commission"),
    (r"\bfinance commission\b", "Finance Commission"),
    (r"\bconsolidated fund\b", "Consolidated Fund"),
    (r"\bemergency\b", "Emergency"),
    (r"\bproclamation\b", "Proclamation"),
    (r"\bamendment\b", "Constitutional Amendment"),
    (r"\bcitizenship\b", "Citizenship"),
    (r"\bschedule\b", "Schedule"),
    (r"\bpanchayat\b", "Panchayat"),
    (r"\bmunicipality\b", "Municipality"),
    (r"\bunion list\b", "Union List"),
    (r"\bstate list\b", "State List"),
    (r"\bconcurrent list\b", "Concurrent List"),
    (r"\btribunal\b", "Tribunal"),
    (r"\bwrit\b", "Writ"),
    (r"\bhabeas corpus\b", "Habeas Corpus"),
    (r"\bmandamus\b", "Mandamus"),
    (r"\bcertiorari\b", "Certiorari"),
    (r"\bordinance\b", "Ordinance"),
    (r"\bjudicial review\b", "Judicial Review"),
    (r"\breservation\b", "Reservation"),
    (r"\bscheduled castes?\b", "Scheduled Castes"),
    (r"\bscheduled tribes?\b", "Scheduled Tribes"),
    (r"\bbackward classes?\b", "Backward Classes"),
    (r"\banti.?defection\b", "Anti-Defection"),
    (r"\bofficial language\b", "Official Language"),
    (r"\bconsumer\b", "Consumer"),
    (r"\bcomplaint\b", "Complaint"),
    (r"\bdefect\b", "Defect"),
    (r"\bdeficiency\b", "Deficiency"),
    (r"\bunfair trade practice\b", "Unfair Trade Practice"),
    (r"\brestrictive trade practice\b", "Restrictive Trade Practice"),
    (r"\bproduct liability\b", "Product Liability"),
    (r"\bunfair contract\b", "Unfair Contract"),
    (r"\bmisleading advertisement\b", "Misleading Advertisement"),
    (r"\bmediation\b", "Mediation"),
    (r"\bdistrict commission\b", "District Commission"),
    (r"\bstate commission\b", "State Commission"),
    (r"\bnational commission\b", "National Commission"),
    (r"\bccpa\b", "CCPA"),
    (r"\bcentral consumer protection authority\b", "Central Consumer Protection Authority"),
    (r"\bmanufacturer\b", "Manufacturer"),
    (r"\bproduct seller\b", "Product Seller"),
    (r"\bspurious goods?\b", "Spurious Goods"),
    (r"\badulterat\b", "Adulterated Products"),
    (r"\be.?commerce\b", "E-Commerce"),
    (r"\bendorsement\b", "Endorsement"),
    (r"\bpenalt\b", "Penalty"),
    (r"\bappeal\b", "Appeal"),
    (r"\bjurisdiction\b", "Jurisdiction"),
]


def matches(key: Column, patterns: list[str]) -> Column:
    """One alternation for each rule set, so that a text is scanned once a set."""
    return F.regexp_like(key, F.lit("|".join(f"(?:{p})" for p in patterns)))


def route(question: Column, model: Column, rules: dict[str, list[str]] = RULES) -> Column:
    """The domain of a question; model: what a classifier says where the rules don't decide."""
    key = space_key(question)
    constitution, consumer = matches(key, rules["constitution"]), matches(key, rules["consumer"])
    return (
        F.when(matches(key, rules["external"]) | matches(key, rules["unrelated"]), "out_of_domain")
        .when(matches(key, rules["article"]), "constitution")
        .when(constitution & ~consumer, "constitution")
        .when(consumer & ~constitution, "consumer_protection")
        .otherwise(model)
    )


def undecided(questions: DataFrame, text: str, rules: dict[str, list[str]] = RULES) -> DataFrame:
    """The questions that need a classifier: only these should reach a model's UDF."""
    return questions.where(route(F.col(text), F.lit(None).cast("string"), rules).isNull())


def concepts(text: Column, table: list[tuple[str, str]] = CONCEPTS) -> Column:
    """Sorted distinct names of the concepts in a text."""
    low = F.lower(text)
    found = F.array(*[F.when(F.regexp_like(low, F.lit(p)), F.lit(name)) for p, name in table])
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


__all__ = ["CONCEPTS", "RULES", "concepts", "legal_reference", "route", "undecided"]
