"""Fixed values of the assessment domain: code sets, aliases, point maxima, prices, weights' neighbours, stop words."""

# Fixed values, in natural order.
DOC_CODES = """BADDP BADUML BLOK BW CH CONTENT COPY DOCTYPE DP EX EXT FILO FORM FORMAT HOV HOW ICH IR JAK KAPTXT LANG MDLINES MEZ
MISSING NOUML NV NVPDOC OK OOP OWNDIF PRED SAZBA SHORT SINGLETON SPACETAB STRUCT STYLE TERM UML WHY""".split()
OTHER_CODES = """AUTHOR COMMENT DECOMPOSE NOOP NOSRP NVI NVP PSR1 PSR12 SRCFORMAT STN0 STN1 STN2 STN3 STN4 STN5 STN6 STN9""".split()
BONUS_CODES = "DP EX NV OK OOP".split()
CODE_ALIASES = {
    "BLOCK": "BLOK", "COMMENTS": "COMMENT", "GRAM.": "GRAM", "NOOOP": "NOOP", "NVI": "NV", "OO": "OOP", "PŘED": "PRED",
    "STRUKT.": "STRUCT", "STYL": "STYLE", "SYLE": "STYLE", "TERM.": "TERM", "TYP.": "TYP",
}
LEGACY_TO_CANONICAL = {
    "BLOK": "SAZBA", "DOCTYPE": "SAZBA", "FORM": "SAZBA", "FORMAT": "SAZBA", "HOW": "HOV", "MDLINES": "SAZBA", "MEZ": "SAZBA",
    "MISSING": "STRUCT", "NVPDOC": "BADDP", "PRED": "SAZBA", "SINGLETON": "BADDP", "SPACETAB": "SAZBA", "UML": "NOUML", "WHY": "JAK",
}
#: Points by year and variant.
MAX_DOC_POINTS = [
    (2013, "php", 200), (2013, "py", 200), (2014, "php", 200), (2014, "py", 200), (2015, "php", 200), (2015, "py", 200), (2016, "php", 200), (2016, "py", 200), (2017, "int", 300), (2018, "int", 200), (2018, "par", 100), (2019, "int", 200), (2019, "par", 100), (2020, "int", 200), (2020, "par", 100), (2021, "int", 200), (2021, "par", 100), (2022, "int", 300), (2022, "par", 100), (2023, "int", 400), (2023, "par", 100), (2024, "int", 400), (2024, "par", 100),
]
#: USD per million tokens: input, cached input, output. The first name that a model's name contains counts.
MODEL_PRICES = [("gpt-5.4-nano", 0.20, 0.02, 1.25), ("gpt-5.4-mini", 0.75, 0.075, 4.50), ("gpt-5.4", 2.50, 0.25, 15.00), ("gpt-5", 15.25, 0.125, 10.00), ("gpt-5-mini", 0.25, 0.0025, 2.00), ("gpt-4.1", 2.00, 0.50, 8.00)]
USD_TO_EUR = 0.92
WEIGHT_NEIGHBOURS = {"AI": ["CITE", "JAK", "CONTENT"], "CITE": ["COPY", "CONTENT"], "COVER": ["FORMAT", "SAZBA", "MISSING"], "DS": ["JAK", "IR", "DP"], "FLUFF": ["SHORT", "STYLE"], "NOSRP": ["OOP", "STRUCT", "DP"], "SEMUML": ["NOUML", "BADUML"]}
STOP_WORDS = "a i je se v na pro k do za s o z u od po jak co to ten ta ale nebo tak by si ne jen ve ze není být také bez atp např".split()
SHORT_MINIMA = {"words": 486, "chars": 3422, "blocks": 7}
LANGUAGES = ("cs", "sk", "en")
PARSED_TYPES = (".pdf", ".md")
DIAGRAM_IMAGES = (".png", ".jpg", ".jpeg", ".svg", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".ico")
#: What is said of a heading without text, by the level of what follows.
EMPTY_SECTION = {
    "title": "Empty section detected", "end title": "Empty section at end of document", "sibling": "Empty section (sibling heading follows with no content)",
    "child": "Section has no introductory text before its subsections", "parent": "Empty subsection at end of its block",
}
BAD_DIAGRAM = "The UML Class Diagram is visually flawed and its structure cannot easily be understood."
#: Codes of a classifier to those of the rules, and names that vision models use for codes.
CLASSIFIER_CODES = {"BADUML": "UML_BAD"}
VISION_ALIASES = {"BADUML": ("BADUML", "UML_BAD"), "UML_BAD": ("BADUML", "UML_BAD"), "OWN DIF": ("OWNDIF", "UML_OWNDIF")}
#: Types of a grammar checker's issues: severity, title, code; and snippets that are no issue.
ISSUE_SEVERITY = {"grammar": 0.4, "misspelling": 0.4}
ISSUE_TITLES = {"grammar": "Grammar Error", "misspelling": "Spelling Error"}
ISSUE_CODES = {"grammar": "GRAMMAR", "misspelling": "SPELLING"}
IGNORED_WORDS = """arity lexer lexeme parser ast dom sys py params expr main self token send parse lark parglare lalr etree minidom
nil true false idx login pyreverse xmlvisitor xmlgenerator backcolon frontcolon blockstat blockpar exprbase exprsel sourcecode
isinstance argparse powershell vscode analyser analysers analysing analysed doesnotunderstand interpreter interpretu runtime int
solobject parent cite_start object args value mypy input_model block tester interpreterresult evaluator class send_message execute
solclass const dispatch eval builtin interpretererror ts diffresult runtimeobject signal npm pydantic lxml string bool diffphase rc
json screenshot""".split()
#: Limits of similarity to a specification, the least chunks of a document, the model of the vectors.
COPY_LIMITS = {"chunk": 0.8, "cover": 0.65, "soft": 0.75, "hard": 0.9}
LEAST_CHUNKS = 3
EMBEDDING_MODEL = "BAAI/bge-m3"
#: Lines that are no evidence: titles, contents, years.
TITLE_LINE = r"(?i)^(implementa[cv]n[iy]|dokumentace|student|login|jmeno|xlogin|zadani)"
CONTENTS_LINE = r"^\s*(\d+\.)+\s*$"
YEAR_LINE = r"(?i)^(20\d{2}\s*/\s*20\d{2}|IPP\s*20\d{2})"
#: Columns of the export of findings.
EXPORT_COLUMNS = """id year task_variant code impact impact_has_sign impact_source impact_shared comment raw_text source_file doc_points
doc_type bonus_points severity confidence judge_status human_status finding_id""".split()
HIDDEN_CODES = ["AIDOC", "DSC_EXT"]
#: Folders that a variant's submissions may lie in, the first that there is counts.
VARIANT_FOLDERS = {"int": ["interpret", "int"], "par": ["parse", "parser"], "php": ["php"], "py": ["python", "py"]}
#: Keys of a rule; those that must be there as text.
RULE_KEYS = """title ac_code severity_weight is_legacy prompt_instruction judge_instruction analyser_id course language backend
requires_pages""".split()
RULE_TEXTS = ("title", "ac_code", "prompt_instruction", "analyser_id")
