"""Wording that ties a role to a place, and wording that takes such a tie back: configuration, stated in full."""

# Metros of the US, boards that list US roles alone, and labels that open a role to the world.
METROS = (
    "new york", "nyc", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "austin",
    "san jose", "jacksonville", "fort worth", "columbus", "charlotte", "indianapolis", "seattle", "denver", "washington", "boston", "el paso",
    "nashville", "detroit", "oklahoma city", "portland", "las vegas", "memphis", "louisville", "baltimore", "milwaukee", "albuquerque",
    "tucson", "fresno", "sacramento", "mesa", "kansas city", "atlanta", "colorado springs", "miami", "raleigh", "omaha", "long beach",
    "virginia beach", "oakland", "minneapolis", "tampa", "tulsa", "arlington", "new orleans", "wichita", "cleveland", "bakersfield", "aurora",
    "anaheim", "honolulu", "santa ana", "riverside", "corpus christi", "lexington", "san francisco", "pittsburgh", "st louis", "cincinnati",
    "st paul", "greensboro", "anchorage", "plano", "lincoln", "orlando", "irvine", "newark", "durham", "chula vista", "toledo", "fort wayne",
    "st petersburg", "laredo", "jersey city", "chandler", "madison", "lubbock", "scottsdale", "reno", "buffalo", "gilbert", "glendale",
    "north las vegas", "winston salem", "chesapeake", "norfolk", "fremont", "garland", "irving", "hialeah", "richmond", "boise", "spokane",
    "baton rouge", "san brae", "dayton", "moreno valley", "santa clarita", "fayetteville", "birmingham", "rochester", "oxnard", "port st lucie",
    "grand rapids", "huntsville", "salt lake city", "yrs", "frisco", "amherst", "round rock", "cambridge",
    "brooklyn", "manhattan", "queens", "bronx", "jersey", "waterbury",
)
US_BOARDS = ("indeed", "glassdoor", "ziprecruiter", "monster")
CONTRACTS = ("worldwide", "global", "globally", "anywhere in the world", "work from anywhere", "b2b", "b2b contract", "freelance", "freelancer", "contract", "contractor", "independent contractor", "c2c")
WORLD = ("worldwide", "anywhere in the world", "work from anywhere", "global remote", "globally remote")
#: Labels that open a role: wording of its own, and regions beside the word "remote".
MARKERS = (
    "worldwide", "work from anywhere", "anywhere in the world", "anywhere in world", "global remote", "globally remote", "remote - global", "remote (global)",
    "remote - worldwide", "remote (worldwide)", "international remote", "remote international", "b2b", "freelance", "contractor", "c2c",
    "pakistan remote", "remote in pakistan", "pakistan (remote)", "remote (pakistan)", "remote - pakistan",
    "apac remote", "asia pacific remote", "south asia remote", "remote (apac)", "apac (remote)",
    "middle east remote", "remote - middle east", "remote (middle east)", "middle east (remote)",
    "mena remote", "remote - mena", "remote (mena)", "mena (remote)", "gcc remote", "remote - gcc", "remote (gcc)", "gcc (remote)",
    "uae remote", "dubai remote", "saudi arabia remote", "qatar remote", "remote (uae)", "remote (dubai)", "uae (remote)", "dubai (remote)", "saudi arabia (remote)", "qatar (remote)",
)

# Places beyond the restricted ones that a role may not ask to live in, home excepted, and groups of places in set phrases.
MORE_ABROAD = (
    "singapore", "malaysia", "thailand", "vietnam", "indonesia", "philippines", "saudi arabia", "saudi", "uae", "united arab emirates",
    "qatar", "kuwait", "bahrain", "oman", "egypt", "turkey", "türkiye", "dubai", "riyadh", "doha", "istanbul", "abu dhabi",
)
AUTHORITIES = ("us", "usa", "united states", "uk", "canada", "eu", "japan", "singapore", "australia")
RESIDENCES = ("us", "usa", "united states", "north america", "canada", "uk", "europe", "germany", "latin america", "poland", "japan", "singapore", "saudi", "uae", "australia", "israel")
ISRAEL = ("israel", "tel aviv", "jerusalem", "haifa")
CLOSED_MARKETS = ("japan", "tokyo", "osaka", "yokohama", "nagoya", "kyoto", "south korea", "seoul", "taiwan", "taipei", "hong kong", "macau", "china", "beijing", "shanghai", "shenzhen", "australia", "sydney", "melbourne", "new zealand", "auckland", "wellington")
TITLE_NATIONS = (
    "us", "usa", r"u\.s\.a?", "uk", "united kingdom", "canada", "europe", "germany", "poland", "brazil", "latam", "israel", "india", "japan", "singapore", "australia", "china",
    "south korea", "korea", "taiwan", "hong kong", "france", "spain", "italy", "netherlands", "sweden", "switzerland", "ireland", "mexico", "colombia", "uae", "saudi arabia",
    "qatar", "kuwait", "bahrain", "oman", "egypt", "turkey", "nigeria", "kenya", "south africa", "russia", "ukraine", "argentina", "chile", "peru", "vietnam", "thailand",
    "malaysia", "indonesia", "philippines", "new zealand",
)
TITLE_HUBS = ("nyc", "sf", "new york", "san francisco", "london", "berlin", "austin", "seattle", "boston", "tel aviv", "jerusalem")
GERMAN_PLACES = (
    "deutschland", "germany", r"bundesrepublik(?:\s+deutschland)?", "berlin", "hamburg", "münchen", "munich", "frankfurt", "köln", "cologne", "stuttgart", "düsseldorf",
    "leipzig", "dresden", "nrw", "nordrhein-westfalen", "bayern", "bavaria", "hessen", "baden-württemberg",
)

# Pins of descriptions; {authority}, {residence}, {israel} and {abroad} are the places above. A pin is looked for where
# a text holds its part and, as a whole run of letters and digits, a word of each of its groups ("abroad" are the words of those places).
PINS = (
    ("", (("reside",),), r"\bmust\s+reside\s+in\s+(?:the\s+)?{residence}\b"),
    ("", (("must",),), r"\bmust\s+be\s+in\s+the\s+(?:us|usa|united states|uk|europe|canada|japan|australia|israel)\b"),
    ("", (("located",),), r"\bmust\s+be\s+located\s+in\s+(?:the\s+)?{residence}\b"),
    ("", (("residence", "residency"),), r"\bresiden(?:ce|cy)\s+(?:is\s+)?(?:required|mandatory|essential|erforderlich)\b"),
    ("", (("residence", "residency"),), r"\bresiden(?:ce|cy)\s+in\s+(?:the\s+)?(?:us|usa|united states|uk|canada|eu|europe|germany|france|poland|spain|italy|japan|singapore|australia|israel)\b"),
    ("", (("us", "usa"), ("only",)), r"\b(?:us|usa)\s+(?:citizenship|citizen|resident|residency|based|candidates?)\s+only\b"),
    ("", (("permanent",),), r"\b(?:us|usa|u\.s\.|uk|canada|eu|european)\s+citizens?\s+or\s+permanent\s+residents?\b"),
    ("", (("uk", "kingdom", "canada", "eu", "european"), ("only",)), r"\b(?:uk|canada|eu|european)\s+(?:candidates?|residen(?:ts?|cy)|based)\s+only\b"),
    ("", (("uk", "kingdom", "canada", "eu", "european"), ("only",)), r"\b(?:uk|united\s+kingdom|canada|eu|european)\s+based\s+(?:candidates?|engineers?|developers?|applicants?)\s+only\b"),
    ("person", (("must",),), r"\bmust\s+be\s+(?:a\s+)?u\.?s\.?\s*persons?\b"),
    ("citizen", (("only",),), r"\bu\.?s\.?\s*citizen(?:s|ship)?\s+only\b"),
    ("", (("japan", "singapore", "saudi", "uae", "australia", "israel"), ("only",)), r"\b(?:japan|singapore|saudi|uae|australia|israel)\s+(?:residen(?:ts?|cy)|citizens?|based)\s+only\b"),
    ("", (("green",), ("card",)), r"\bgreen\s+card(?:\s+holder)?\b"),
    ("", (("right",),), r"\b(?:uk|united\s+kingdom)\s+right\s+to\s+work\b"),
    ("", (("right",),), r"\bright\s+to\s+work\s+in\s+(?:the\s+)?(?:uk|united\s+kingdom|eu|london|canada|japan|singapore|australia)\b"),
    ("", (("eu", "european"),), r"\b(?:eu|european)\s+(?:resident|residency|work|working)\s+(?:permit|right|authoriz(?:e|a)tion)\b"),
    ("", (("we",), ("sponsor", "hire")), r"\bwe\s+(?:are\s+unable\s+to|cannot|do\s+not)\s+(?:sponsor|hire\s+outside|hire\s+internationally)\b"),
    ("", (("authorized", "able", "eligible"), ("work",)), r"\b(?:authorized|able|eligible)\s+to\s+work\s+in\s+(?:the\s+)?{authority}\b"),
    ("", (("authorization",),), r"\b(?:us|u\.s\.|usa)\s+work\s+authorization\b|\bwork\s+authorization\s+in\s+(?:the\s+)?{authority}\b"),
    ("", (("permit",),), r"\b(?:us|u\.s\.)\s+work\s+permit\b"),
    ("", (("c2c", "w2", "w"),), r"\b(?:no\s+c2c|w-?2\s+only|w2\s+candidates?)\b"),
    ("", (("clearance",),), r"\bsecurity\s+clearance\s+required\b|\bactive\s+secret\s+clearance\b"),
    ("", (("within",),), r"\bwithin\s+\d+\s*(?:[-–to]+\s*\d*\s*)?hours?\s+of\s+(?:london|uk|gmt|cet|bst|est|cst|mst|pst)\b"),
    ("", (("must",), ("based",)), r"\bmust\s+be\s+based\s+in\s+(?:cet|bst|gmt|est|cst|mst|pst)\b"),
    ("", (("us",), ("eastern", "central", "pacific", "mountain")), r"\bus\s+(?:eastern|central|pacific|mountain)\b"),
    ("", (("eastern", "central", "pacific", "mountain"),), r"\b(?<!asia[\s-])(?<!apac\s)(?<!apac/)(?<!apac\s/\s)(?<!apac\s-\s)(?:eastern|central|pacific|mountain)\s+(?:time|hours?|zone)\b"),
    ("", (("est", "cst", "mst", "pst"), ("time", "hour", "hours", "zone", "business")), r"\b(?:est|cst|mst|pst)\s+(?:time|hours?|zone|business)\b"),
    ("", (("business",),), r"\bbusiness\s+hours?\s+(?:est|cst|mst|pst|et|ct|mt|pt)\b"),
    ("", (("eastern", "central", "pacific", "mountain"), ("est", "cst", "mst", "pst")), r"\b(?:eastern|central|pacific|mountain)\s*\(\s*(?:est|cst|mst|pst)\s*\)"),
    ("", (("overlap",),), r"\bmust\s+overlap\b|\b\d+\s+hours?\s+(?:of\s+)?(?:timezone\s+)?overlap\b"),
    ("", (("remote", "wfh"),), r"\b(?:fully\s+remote|remote|wfh)\s+(?:role|job|position)?\s*(?:in|within)\s+(?:the\s+)?(?:us|usa|united states|uk|eu|europe|canada|germany|india|latin america)\b"),
    ("office", (("week",),), r"\b(?:1|2|3|4)\s*days\s+(?:a|per)\s+week\s+(?:in|from)\s+(?:the\s+)?office"),
    ("", (("onsite", "site"),), r"\b(?:onsite|on-site)\b.*(?:in\s+\w+|office\b)"),
    ("", (("relocation",),), r"\brelocation\s+(?:required|assistance\s+to)\b"),
    ("", (("commute",),), r"\bmust\s+be\s+able\s+to\s+commute\b"),
    ("", (("israel", "aviv", "jerusalem", "haifa"),), r"\b(?:based\s+in|reside(?:s|nt)?\s+in|resident\s+of|located\s+in|office\s+in)\s+{israel}\b"),
    ("", (("israel", "israeli", "aviv"),), r"\b(?:israeli?|tel\s+aviv)\s+(?:residents?|based|citizens?|nationals?|only|work\s+permit|office|location)\b"),
    ("", (("israel", "aviv", "jerusalem", "haifa"),), r"\b(?:must|need(?:ing)?\s+to|required\s+to)\s+(?:be\s+)?(?:based|reside|live|work)\s+in\s+{israel}\b"),
    ("only", (("israel", "aviv", "jerusalem", "haifa", "israelonly", "avivonly", "jerusalemonly", "haifaonly"),), r"\b{israel}\s*[-–]?\s*only\b"),
    ("", (("israel",),), r"\b(?:right\s+to\s+work|work\s+authorization)\s+in\s+israel\b"),
    ("", (("only", "restricted"), "abroad"), r"\b(?:only|restricted\s+to)\s+(?:candidates\s+)?(?:based\s+)?in\s+(?:the\s+)?{abroad}\b"),
    ("", (("only",), "abroad"), r"\bonly\s+candidates\s+(?:based\s+)?in\s+(?:the\s+)?{abroad}\b"),
    ("", (("only",), "abroad"), r"\bin\s+(?:the\s+)?{abroad}\s+only\b"),
    ("", (("only",), "abroad"), r"\b{abroad}\s+(?:(?:residents?|nationals?|based|citizens?)\s+)?only\b"),
    ("", (("must", "required"), "abroad"), r"\b(?:must|required)\s+(?:to\s+)?be\s+(?:based|located|residing)\s+in\s+(?:the\s+)?{abroad}\b"),
    ("", (("preferred",), "abroad"), r"\b(?:based|reside|residing|living|located)\s+in\s+(?:the\s+)?{abroad}\s+preferred\b"),
    ("", (("prefer", "preferably"), "abroad"), r"\bprefer(?:ably)?\s+(?:based|located|living)\s+in\s+(?:the\s+)?{abroad}\b"),
    ("", (("remote",), "abroad"), r"\bremote\s*[-–,]\s*{abroad}\b(?!\s+(?:and|or|vs)\b|\s*(?:,|&))"),
    ("", (("remote",), "abroad"), r"\bremote\s*[-–,]\s*{abroad}\s*(?:,|and|or|vs)\s+{abroad}\b"),
)

# Wording that takes a demand for US persons back, or makes it hard.
US_TAKEN_BACK = (
    r"\bnot\s+(?:a\s+)?(?:required|requirement|mandatory|necessary|needed)\b", r"\b(?:isn't|aren't)\s+required\b", r"\bshall\s+not\s+be\s+required\b",
    r"\bno\s+(?:us\s+|u\.s\.(?:\.a)?\s*)?(?:persons?|citizenship|requirement)\b", r"\b(?:does|do|don't)\s+(?:not\s+)?require\b",
    r"\brequirement\s*(?::|is)\s*none\b", r"\bnone\s+required\b", r"\bwithout\s+(?:a\s+)?(?:us\s+|u\.s\.(?:\.a)?\s*)?persons?\b",
    r"\bnon[-\s]?(?:us|u\.s\.(?:\.a)?)(?:\s+(?:persons?|personnel))?\b",
)
HARD = r"\bmust\s+(?:be|work|have|possess)\b|\b(?:is|are)\s+required\b|\brequires?\b"

# Residency in German and French, and what takes it back in its clause. {de} is a German place, {gap} stays within a sentence.
_MUST = r"m(?:u|ü)(?:ss|ß)(?:t|en|te|ten|st|sten)?"
_NEED = r"(?:erforderlich|pflicht|voraussetzung|zwingend|nötig|benötigt|notwendig|required|must)"
LOCAL_PINS = (
    r"\bwohnsitz\s+(?:in|innerhalb\s+der|i\.?\s*d\.?)\s+{de}\b", rf"\bwohnsitz\s+{{de}}\b{{gap}}{{{{0,40}}}}\b{_NEED}\b", rf"\b{_NEED}\b{{gap}}{{{{0,40}}}}\bwohnsitz\s+{{de}}\b",
    r"\b(?:mit|ohne)\s+wohnsitz\s+(?:(?:in|innerhalb\s+der|i\.?\s*d\.?)\s*)?{de}\b", r"\bwohnort\b{gap}{{0,40}}\b(?:in\s+)?{de}\b", r"\b(?:in\s+{de}\s+wohnen|wohnen\s+in\s+{de})\b",
    rf"\b{_MUST}\b{{gap}}{{{{0,60}}}}\b(?:in\s+)?{{de}}\b{{gap}}{{{{0,40}}}}\b(?:wohnen|ansässig|leben)\b", rf"\b{_MUST}\b{{gap}}{{{{0,60}}}}\b(?:wohnen|ansässig|leben)\b{{gap}}{{{{0,40}}}}\b(?:in\s+)?{{de}}\b",
    r"\bansässig(?:keit|en)?\s+(?:in\s+)?{de}\b", r"\baufenthaltserlaubnis\s+(?:für|in)\s+(?:deutschland|germany)\b",
    r"\brésid(?:ant|erez|er)\s+en\s+(?:france|europe)\b", r"\brésidence\s+(?:en|dans\s+l'|dans\s+le|dans\s+la|dans)?\s*(?:france|europe|union\s+européenne|ue)\b",
    r"\brésident(?:e)?s?\s+en\s+(?:france|europe)\b", r"\bbas[eé]e?s?\s+en\s+france\b", r"\bdomicilié(?:e)?\s+en\s+france\b", r"\bdomiciliation\s+en\s+france\b",
)
LOCAL_TAKEN_BACK = (
    r"\bnicht\b{gap}{{0,15}}\b(?:erforderlich|benötigt|nötig|vorgeschrieben|zwingend|pflicht)\b", r"\bkeine?\s+pflicht\b", rf"\b{_MUST}\s+nicht\b",
    r"\bohne\s+(?:[a-zäöüß]+\s+){{0,2}}wohnsitz\b", r"\bohne\s+ansässigkeit\b", r"\bkein(?:e|er|en)?\s+(?:wohnsitz|ansässigkeit)\b",
    r"\b(?:wohnen|leben)\s+(?:ist\s+)?(?:möglich|possible)\b", r"\b(?:wohnsitz|ansässigkeit)\b{gap}{{0,30}}\bmöglich\b", r"\bmöglich\s+für\s+(?:alle|kandidaten|bewerber)\b",
    r"\b(?:wohnort|wohnsitz)\s+(?:frei|free)\b", r"\bk(?:a|ä|ö|o)nn(?:st|en)?\b{gap}{{0,60}}\b(?:wohnen|leben)\b",
    r"\bnon\s+requi(?:s|se|ses)\b", r"\b(?:non|pas)\s+obligatoire\b", r"n'est\s+pas\s+(?:requis|requise|nécessaire|obligatoire)\b", r"\bpas\s+besoin\s+de\b", r"\bsans\s+(?:résidence|résider|domicile)\b",
    r"\b(?:residence|residency|domicile)\s+not\s+required\b", r"\bno\s+(?:residence|residency)\s+requirement\b", r"\bwithout\s+(?:a\s+)?(?:residence|residency)\b",
)
CLAUSE_ENDS = r"[,;:—–()\[\]]+|\b(?:und|aber|oder|sondern|mais|et|ou|and|or|but)\b"
CLIENTS = r"\b(?:notre\s+client|notre\s+entreprise|la\s+soci[ée]t[ée]|notre\s+partenaire|our\s+client|our\s+company)\b"
