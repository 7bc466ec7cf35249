"""Fixed values of the domain: levels, aliases, markers, weights."""

#: Voltage levels, highest first.
LEVELS = ["HöS", "HöS/HS", "HS", "HS/MS", "MS", "MS/NS", "NS"]

#: Levels that each bucket of connection points lets one expect.
BUCKET_LEVELS = {"ns": ["NS"], "ms": ["MS", "MS/NS"], "hs": ["HS", "HS/MS"], "hoe": ["HöS", "HöS/HS"]}

#: Names of levels in documents.
LEVEL_ALIASES = {
    "hochspannung": "HS",
    "hochspannungsnetz": "HS",
    "inhs": "HS",
    "hs": "HS",
    "mittelspannung": "MS",
    "mittelspannungsnetz": "MS",
    "inms": "MS",
    "ms": "MS",
    "msp": "MS",
    "mittelspannung (msp)": "MS",
    "niederspannung": "NS",
    "niederspannungsnetz": "NS",
    "inns": "NS",
    "ns": "NS",
    "nsp": "NS",
    "niederspannung (nsp)": "NS",
    "umspannung hoch-/mittelspannung": "HS/MS",
    "umspannung hoch -/mittelspannung": "HS/MS",
    "umspannung hs/ms": "HS/MS",
    "umspannung ms/hs": "HS/MS",
    "ms/hs": "HS/MS",
    "umspannung zur mittelspannung": "HS/MS",
    "aushs": "HS/MS",
    "hs/ms": "HS/MS",
    "höchstspannung mit umspannung auf hochspannung": "HöS/HS",
    "hochspannung mit umspannung auf mittelspannung": "HS/MS",
    "hochspannung mit umspannung auf ms": "HS/MS",
    "mittelspannung mit umspannung auf niederspannung": "MS/NS",
    "mittelspannung mit umspannung auf ns": "MS/NS",
    "umspannung mittel-/niederspannung": "MS/NS",
    "umspannung mittel -/niederspannung": "MS/NS",
    "umspannung ms/ns": "MS/NS",
    "umspannung ns/ms": "MS/NS",
    "ns/ms": "MS/NS",
    "umspannung zur niederspannung": "MS/NS",
    "ausms": "MS/NS",
    "ms/ns": "MS/NS",
    "msp/nsp": "MS/NS",
    "umspannung msp/nsp": "MS/NS",
    "höchstspannung": "HöS",
    "höchstspannungsnetz": "HöS",
    "hös": "HöS",
    "umspannung höchst-/hochspannung": "HöS/HS",
    "umspannung hös/hs": "HöS/HS",
    "umspannung hs/hös": "HöS/HS",
    "aushös": "HöS/HS",
    "hös/hs": "HöS/HS",
    "hs/hös": "HöS/HS",
}

#: Level of a voltage in kV.
KV_LEVELS = {"0.4": "NS", "10": "MS", "20": "MS", "30": "MS", "110": "HS", "220": "HöS", "380": "HöS"}

#: Markers of "no value" for numbers, for time windows and for cells.
NO_NUMBER = ["-", "n/a", "null", "none", "", "entfällt", "–", "k.a.", "keine angabe"]
NO_TIME = ["-", "entfällt", "keine", "n/a", "", "k.a.", "keine angabe"]

#: Weights, anchors and fallbacks of the importance score.
IMPORTANCE_WEIGHTS = {"area": 0.15, "connection_points": 0.70, "customers": 0.15}
IMPORTANCE_P90 = {"area": 1500.0, "connection_points": 20000.0, "customers": 500000.0}
IMPORTANCE_FALLBACK = {"area": 0.25, "customers": 0.10, "has_customers": 0.35}

#: Weights of words in file names.
FILE_WORDS = {
    "netzentgelte": {"preisblatt": 5, "preisblaetter": 5, "netzentgelt": 5, "netzentgelte": 5, "preise": 5, "netznutzung": 3, "entgelt": 3, "strom": 1},
    "hlzf": {"zeitfenster": 5, "hlzf": 5, "atypisch": 5, "hochlast": 5, "benutzungsstunden": 3, "regelung": 5, "regelungen": 5},
}

#: Query parameters that don't tell pages apart.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "session_id", "sessionid", "sid", "ref", "referrer", "source", "tracking", "_ga", "_gl", "mc_cid", "mc_eid", "forced"]

#: Words that speak against a document, with their penalties.
NEGATIVE_WORDS = [
    ("gas", -100),
    ("messstellenbetrieb", -50),
    ("msbg", -30),
    ("messsystem", -30),
    ("messeinrichtung", -30),
    ("messwesen", -30),
    ("vermiedene", -50),
    ("referenzpreis", -50),
    ("konzessionsabgabe", -50),
    ("singul", -30),
    ("individuelle", -25),
    ("vorlaeufig", -25),
    ("vorläufig", -25),
    ("entwurf", -25),
]

#: Addresses that hand out files by token.
TOKEN_URLS = [
    r"/(media_token|get_file|download_id|fileadmin)/[\w-]+$",
    r"/ajax/.*download",
    r"\.(asp|aspx|php)\?.*file",
    r"/_layouts/.*/download",
    r"/blob/",
    r"/download\.(?:php|aspx?)\?",
    r"/Binaerfile\.asp",
    r"/getmedia/",
    r"/dms_download/",
    r"/attachment/",
    r"/file\.axd",
]

#: Places of years in addresses.
YEAR_PATTERNS = [r"/(\d{4})/", r"-(\d{4})\.", r"_(\d{4})_", r"[?&]year=(\d{4})", r"/(\d{4})-"]

#: Endings of documents.
DOCUMENT_ENDINGS = [".pdf", ".pdfx", ".xlsx", ".xls", ".docx", ".doc", ".zip"]

#: Words of which a document of a kind must hold one.
WORDS_NEEDED = {
    "netzentgelte": ["netzentgelt", "netznutzungsentgelt", "entgeltblatt", "preisblatt"],
    "hlzf": ["hochlastzeitfenster", "hlzf", "hochlast"],
}
#: Words that speak for a kind.
WORDS_FOR = {
    "netzentgelte": ["leistungspreis", "arbeitspreis", "ct/kwh", "€/kw", "eur/kw", "netznutzung", "netzentgelt", "entgelt", "preisblatt", "netzzugang", "preise", "tarifblatt", "entgeltblatt", "jahresleistungspreis", "leistungsentgelt", "arbeitsentgelt"],
    "hlzf": ["hochlastzeitfenster", "hochlast", "zeitfenster", "hlzf", "§19", "stromnev", "spitzenlast", "peak", "hochlastzeit", "winter", "sommer", "herbst", "frühling", "fruehling", "entfällt", "entfaellt", "uhr"],
}
#: Words that speak against a kind.
WORDS_AGAINST = {
    "netzentgelte": ["hochlastzeitfenster", "hlzf", "zeitfenster", "hausanschluss", "netzanschluss", "anschlussantrag", "einspeiser", "einspeisevergütung", "photovoltaik", "stromzähler", "zählerstand", "ablesekarte", "störungsmeldung", "störung melden", "stellenangebot", "karriere", "job", "kontaktformular", "anfahrt", "impressum", "datenschutz", "cookie", "agb", "elektromobilität", "ladesäule", "wallbox", "bauherren", "neubau", "baustrom"],
    "hlzf": ["hausanschluss", "netzanschluss", "anschlussantrag", "stellenangebot", "karriere", "job", "kontaktformular", "impressum", "datenschutz"],
    "all": ["gas"],
}
#: Patterns of data in lower-cased text, by kind.
DATA_PATTERNS = {
    "netzentgelte": [r"\d+[,\.]\d{2}\s*ct", r"\d+[,\.]\d{2}\s*€", r"\d+[,\.]\d{2}\s*Euro", r"\d+[,\.]\d+\s*€/k[wW]", r"\d+[,\.]\d+\s*ct/k[wW]h", r"(niederspannung|mittelspannung|hochspannung)"],
    "hlzf": [r"\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2}", r"(winter|sommer|herbst|fr[üu]hling)", r"entf[äa]llt"],
}
#: The kind "all" has the words and patterns of both, but words of its own against it.
for _held in (WORDS_NEEDED, WORDS_FOR, DATA_PATTERNS):
    _held["all"] = [*_held["netzentgelte"], *_held["hlzf"]]

#: Words that make a page of a longer document relevant.
PAGE_WORDS = ["netzentgelt", "entgelt", "preisblatt", "leistungspreis", "arbeitspreis", "hochlastzeitfenster", "hochlastzeit", "hochlast", "netznutzung", "mittelspannung", "niederspannung", "hochspannung", "umspannung"]

#: Words of pages and of tables that hold data of a kind.
EMBEDDED_WORDS = {
    "hlzf": {"page": ["hochlast", "zeitfenster", "hlzf", "winter", "sommer"], "table": ["uhr", "winter", "sommer", "01.11", "31.03", "umspannung", "spannung"]},
    "netzentgelte": {"page": ["netzentgelt", "preisblatt", "entgelt", "tarif", "arbeitspreis", "leistungspreis"], "table": ["ct/kwh", "eur/kw", "niederspannung", "mittelspannung", "hochspannung", "netzebene"]},
}

#: How a page's text tells a year, by kind.
EMBEDDED_YEARS = {
    "hlzf": [r"gültig ab 01\.01\.(\d{4})", r"ab (\d{4})", r"(\d{4})"],
    "netzentgelte": [r"gültig ab 01\.01\.(\d{4})", r"(\d{4})"],
}

#: Points of a page with data, of each word, and of the year asked for.
EMBEDDED_POINTS = {"hlzf": {"table": 50, "word": 7, "year": 25}, "netzentgelte": {"table": 15, "word": 3, "year": 25}}

#: Words of addresses with their points, by kind; a group counts once.
ADDRESS_POINTS = {
    "netzentgelte": [(["netzentgelt", "preisblatt", "entgelt", "tarif"], 15), (["leistungspreis", "arbeitspreis"], 10), (["hochlast", "hlzf", "zeitfenster", "regelung"], -20)],
    "hlzf": [(["hochlast", "hlzf", "zeitfenster"], 20), (["regelung"], 5)],
}

#: Words of addresses that are about time windows for certain.
WINDOW_ADDRESSES = ["hlzf", "hochlast", "zeitfenster"]

#: What no text that is stored may hold.
DANGEROUS = [r"<script", r"javascript:", r"vbscript:", r"on\w+\s*=", r"data:text/html", r"data:application/", r"expression\s*\(", r"url\s*\(\s*['\"]?javascript", r"\x00", r"&#"]

#: Markers of pages that let no crawler in.
PROTECTION_MARKERS = ["enable javascript", "javascript is required", "cf_chl_opt", "challenge-platform", "__cf_bm", "just a moment", "checking your browser", "ddos protection by"]

#: Systems by a part of the generator's name.
SYSTEMS = {"typo3": "TYPO3", "wordpress": "WordPress", "joomla": "Joomla", "drupal": "Drupal", "contao": "Contao", "wix": "Wix", "squarespace": "Squarespace"}

#: Formats by first bytes, as hexadecimal digits.
MAGIC = {"25504446": "pdf", "D0CF11E0": "xls"}

#: Words of which a price sheet's first page has one.
GLANCE_WORDS = ["netzentgelt", "leistungspreis", "arbeitspreis", "preisblatt"]

#: Bounds of imported records.
BOUNDS = {"year": (2000, 2100), "price": (0, 1_000_000), "records": 500, "ranges": 10}
STATUSES = ["unverified", "verified", "flagged", "rejected"]

#: Documents whose address is known: company, kind, year, address.
KNOWN_DOCUMENTS = [
    ("netze bw", "netzentgelte", 2025, "https://assets.ctfassets.net/xytfb1vrn7of/7vhTdFhuKlhLpC8BNOgN3e/369f35dc195a3b8890873942bd7df432/netzentgelte-strom-2025.pdf"),
    ("netze bw", "netzentgelte", 2024, "https://assets.ctfassets.net/xytfb1vrn7of/6Wb8sYU8x0Fw6benikLxGo/66537b6b8070d5503b1165d2aad21b02/netzentgelte-strom-2024.pdf"),
    ("netze bw", "regelungen", 2025, "https://assets.ctfassets.net/xytfb1vrn7of/01bujLCqkK8CFb4NgKfbnu/12f56b562fab37f09d41cc6924994e3e/regelungen-fuer-die-nutzung-des-stromverteilnetzes-2025.pdf"),
    ("netze bw", "regelungen", 2024, "https://assets.ctfassets.net/xytfb1vrn7of/2gDZwU8Xvjl80uIctHlNYe/738081518a3240d77968d024458e2f15/regelungen-fuer-die-nutzung-des-stromverteilnetzes-2024.pdf"),
]

#: What counts as no data in an extracted field, and usual ranges of its prices.
NO_DATA = ["-", "n/a", "null", "none", "", "entfällt", "keine"]
USUAL = {"arbeit": (0.01, 20), "leistung": (0, 500)}

#: Functions of a company in the code register, the first the most wanted.
WANTED_FUNCTIONS = ["Netzbetreiber", "Verteilnetzbetreiber", "Übertragungsnetzbetreiber"]
