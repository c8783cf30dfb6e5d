"""Fixed values.

Word lists, lookup tables, patterns and numeric constants that have to equal the
published behaviour for results to match.  They are data, not logic: every other
module imports them from here.

Contractions are left out of the word lists: the tokeniser splits on apostrophes,
so an entry such as "can't" could never equal a token.
"""
from __future__ import annotations

# --------------------------------------------------------------------------- words
STOPWORDS = tuple(
    """
    a about above after again against all also am an and any are as at be because been before being below
    between both but by can cannot could did do does doing down during each few for from further had has have
    having he her here hers herself him himself his how i if in into is it its itself me more most my myself no
    nor not of off on once only or other ought our ours ourselves out over own same she should so some such than
    that the their theirs them themselves then there these they this those through to too under until up very
    was we were what when where which while who whom why with would you your yours yourself yourselves
    please tell know need needs want wants like get give let us okay ok um uh hmm well just really actually
    basically kind sort thing things something anything lot much many one yeah yes hey hi
    """.split()
)

# last words that leave an utterance unfinished
DANGLING = tuple(
    """
    a an the and or but of in on at to for with about from by into onto over under between my our your their his
    her its this that these those some any need want like know tell get find check what which who whose how when
    where is are was were be been do does did can could would should will shall i we you they he she it also plus
    as than if whether because so then while about regarding around per via including especially without within
    before after until till across through during against among toward towards upon near take
    """.split()
)

# dangling words after which a comma does end the clause, and two extra words after which it does not
COMMA_ENDS_CLAUSE = tuple("that this these those it need want know tell get find check".split())
COMMA_PAUSE_EXTRA = ("am", "i")

# terms that never carry a topic (compared after stemming)
GENERIC_WORDS = tuple(
    """
    thanks thank helpful great perfect cool awesome nice good fine sure right maybe stuff question quick help idea
    lot bit time today tomorrow tonight anyway pretty okay alright thing things wonderful brilliant appreciate much
    bye hello hey morning evening happen happens sorry wait next week month year day days everyone someone something
    think supposed try first mention forgot realistically end whatever around roughly approximately people
    run running look looking planning go going come coming take taking make get got keep keeps need want use have do
    bring send ask start say see hand tell know person last moved move moving changed change mention place stuff
    """.split()
)

# title words that do not identify an entity
TITLE_GENERIC = ("policy", "rule", "guide", "guideline", "sheet", "fact", "venue", "process", "requirement",
                 "document", "overview", "support")

# formatting words that are not new content in a presentation request
FORMAT_WORDS = ("bullet", "point", "short", "version", "line", "sentence", "list", "tabl", "part", "bit", "miss",
                "catch", "last", "key", "main", "put", "give", "make", "turn", "format", "send", "write", "read",
                "quick", "simple", "plain", "english", "form")

# spoken word -> written terms (both sides are stemmed before use)
SYNONYMS = {
    "food": "cater meal", "meal": "cater", "lunch": "meal cater", "snack": "cater", "drink": "cater",
    "uber": "cab taxi", "ola": "cab taxi", "taxi": "cab", "lyft": "cab taxi",
    "wifi": "internet", "internet": "wifi",
    "resign": "notice resignation", "quit": "notice resignation",
    "vacation": "leave", "holiday": "leave", "pto": "leave", "sick": "leave",
    "boss": "manager", "salary": "pay", "refund": "reimburs", "money": "reimburs",
    "computer": "laptop", "mobile": "phone", "cellphone": "phone", "kid": "child", "baby": "child",
    "stay": "hotel accommodation", "room": "hotel accommodation",
}

# --------------------------------------------------------------------------- numbers in speech
COUNT_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
               "ten": 10, "single": 1, "couple": 2, "pair": 2}
UNIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
              "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS_WORDS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "lakh": 100000, "lakhs": 100000}
COUNT_NOUNS = "bullet|bullets|points|point|lines|line|sentences|sentence|items|things|parts"

# --------------------------------------------------------------------------- spoken normalisation
ALIASES = (
    (r"\b(the )?U\.?S\.?A?\b|\bthe States\b|\bAmerica\b", "USA"), (r"\bU\.?K\.?\b|\bBritain\b|\bEngland\b", "UK"),
    (r"\bBangalore\b", "Bengaluru"), (r"\bBombay\b", "Mumbai"), (r"\bMadras\b", "Chennai"),
    (r"\bGurgaon\b", "Gurugram"), (r"\bPoona\b", "Pune"), (r"\bwi-?fi\b", "Wi-Fi"),
    (r"(?i)\b(pounds?|quid|sterling)\b", "GBP"), (r"(?i)\beuros?\b", "EUR"), (r"(?i)\bdollars?\b", "USD"),
    (r"(?i)\byen\b", "JPY"), (r"(?i)\brupees?\b", "INR"),
)
FILLERS = (
    r"\bum+\b", r"\buh+\b", r"\berm+\b", r"\bhmm+\b", r"\bmm+\b", r"\byou know\b", r"\bi mean\b(?!,)",
    r"\bkind of\b", r"\bsort of\b", r"\bbasically\b", r"\bliterally\b", r"\blike,", r",\s*like\b",
    r"\bso yeah\b", r"\bokay so\b", r"\bjust\b", r"\bactually\b(?!,? no)", r"\breally\b", r"\bpretty much\b",
)
REPAIR = (r"(^|[,.;?!])([^,.;?!]*?)\s*,\s*"
          r"(?:(?:no sorry|no wait|no no|sorry|no|or rather|scratch that|i mean|i meant)(?:\s*,?\s*(?:i mean|i meant))?)"
          r"\s*,?\s+")

# --------------------------------------------------------------------------- clause patterns
COORDINATORS = r"(?:oh and also|oh and|and also|and then|and what about|as well as|along with|and|plus)"
LIST_JOINERS = (",", "and", "plus", "as well as", "along with", "and also", "oh and", "oh and also",
                "and what about", ";")
LEAD_IN = (r"^((so|and|oh|okay|ok|hey|hi|hello|well|also|but|hmm|right|alright|now|then|plus|wait|"
           r"yeah|yes|great|cool|thanks|thank you|quick question|one thing|one more thing)\b[,\s]*)+")
PREPOSITION_START = (r"^(for|at|in|on|to|from|with|within|about|regarding|during|after|before|like|maybe|"
                     r"around|roughly|approximately|more like|by|until|than|because|since|cause|so that|"
                     r"as long as|unless|\d+)\b")
WH_ANYWHERE = r"\b(what|what's|how|which|when|where|who|whether)\b"
DISTINCT_QUESTION = (r"^(how (often|long|much|many|early|late|soon|quickly|far)|when|when's|where|where's|who|"
                     r"who's|which|is it|are they|can it|does it|do they)\b")
QUESTION_START = (r"^(what|what's|whats|how|which|when|when's|where|where's|who|who's|whom|whose|why|is|are|am|was|"
                  r"were|do|does|did|can|could|should|shall|will|would|may|might|must|any|anything|if)\b")
REQUEST_CUE = (r"\b(need|needs|want|wanted|looking for|find|tell me|know|check|summari[sz]e|explain|plan|book|recommend|"
               r"suggest|help me|options|allowed|eligible|entitled|how much|how many|how long|how early|how late|"
               r"what happens|any idea|wondering)\b")
CONTEXT_START = (
    r"^((it's|it is|it'll be|it will be|it was|its|it gets|it keeps|it has|we're|we are|we'll be|we've|we have|"
    r"i'm|i am|i've|i have|i'll be|i'd be|i got|i was|this is|that's|there'll be|there will be|turns out|"
    r"by the way|btw|heading|travell?ing|flying|going to)\b|(my|our|the|this|that) [\w' -]{1,30}?"
    r"(\b(is|was|are|were|has|had|got|will|includes?|keeps?|dies|died|expires?|runs?)\b|'s\b)"
    r"|(the )?(trip|event|workshop|booking|flight|meeting|training|venue|receipt|rate|hotel|offsite|launch|team|claim|"
    r"stay|laptop|phone)\b)")
PREAMBLE = (
    r"^((so|and|also|oh|okay|ok|hey|hi|hello|well|right|quick question|one more thing|one thing|hmm|wait|"
    r"alright|now)[,\s]+)*((i|we)\s+(also\s+)?(need|want|would like|'d like|wanted)\s+(to\s+)?(know|check|find out|"
    r"understand|get|see|ask)?\s*(about|whether|if)?\s*|can you\s+(please\s+)?(tell me|summari[sz]e|check|"
    r"explain|find|give me|let me know)?\s*(about)?\s*|could you\s+(please\s+)?(tell me|summari[sz]e|check|"
    r"explain|find|give me)?\s*|please\s+|tell me\s+(about\s+)?|do you know\s+|i was wondering\s+(if|whether)?\s*|"
    r"any idea\s+)?")
PLAN_VERB_START = (r"^((i|we)\s+)?((also|still)\s+)?((need|want|have|'d like|would like|am going|are going)\s+to\s+)?"
                   r"(plan|organi[sz]e|arrange|host|hold|run|set up|put together|book|find|get)\s+")
ARTICLE_START = r"^(the|a|an|any|whatever|and|some)\s+"
APPROX_BEFORE_NUMBER = r"\b(about|around|roughly|approximately|like)\s+(\d)"
EMPTY_ENDING = r"\s+(there are|there is|we need|we have|you have|out there)$"
NOUN_PHRASE_START = r"^(the|a|an|this|that|our|my|their)\b"
PEOPLE = (r"\b(\d{1,5})\s*(?:\+\s*)?(people|persons|attendees|participants|guests|pax|folks|"
          r"delegates|heads|employees|members|seats|of us)\b")
ANAPHORA = (r"\b(it|its|it's|they|them|their|there|that|those|these|this|same|such|ones|him|her|"
            r"what about|how about)\b|\b(the|that|this|new|same|which|other) one\b")
EXISTENTIAL = r"\b(is|are|was|were|will)\s+there\b|\bthere\s+(is|are|was|were|'s|will)\b"
PLACE_DEIXIS = r"\b(there|that place|same (place|venue|trip|hotel)|they|them|it)\b"
CAPACITY_WORDS = r"\b(venue|room|hall|fit|hold|capacity|seat|accommodat|space|host)"
CAPACITY_QUESTION = r"\bhow many (people|guests|attendees|of us)\b|\b(hold|fit|seat|accommodate)\b"

LABEL_WH = (r"(what's|whats|what is|what are|what|which|how much|how many|how long|how early|how late|how often|"
            r"how quickly|how soon|how|when's|when is|when|where's|where|who's|who|whether|is there|are there)")
LABEL_AUX_START = r"^(do|does|did|can|could|should|would|will|is|are|am)\s+(i|we|they|you|it)\s+"
LABEL_AUX_TAIL = r"\s+\b(do|does|did|can|could|should|would|will|am|is|are|have|has)\s+(i|we|you|they|it|he|she)\b.*$"
LABEL_MODAL_TAIL = r"\s+\b(i|we|you|they)\s+(have to|need to|must|should|can|get|am|are|'re|'m)\b.*$"
LABEL_PREP_TAIL = r"\b(by when|by|for|of|to|in|at|on|with)$"

# --------------------------------------------------------------------------- turn-gate cues
PRESENTATION = (
    r"\b(repeat|say (that|it) again|read (that|it) back|come again|(i )?missed (that|the last)|didn'?t catch|"
    r"shorter|shorten|brief(er|ly)?|gist|tl;?dr|bullet|bullets|bullet points|key points|main points|"
    r"summari[sz]e (that|it|this|the (last|previous|above))|sum (that|it) up|rephrase|reword|simplify|simpler|"
    r"in short|recap|one[- ]line(r)?|one sentence|short version|quick version|shorter version|the last (part|bit)|"
    r"as a list|as a table|in plain english|condense|(go|run) (over|through) (that|it|this)( again)?|"
    r"walk me through (that|it) again|in a (quick |short |simple )?list|step by step|numbered)\b")
DEIXIS = (r"\b(that|it|this|your (last )?answer|the (last|previous) (answer|part|bit)|the above|"
          r"what you (just )?said)\b")
CHITCHAT = (
    r"^\W*((ok(ay)?|cool|great|perfect|awesome|nice|thanks|thank you( so much| very much)?|cheers|got it|"
    r"understood|alright|all right|sounds good|that'?s (really )?(helpful|great|perfect|all|it|clear|useful)|"
    r"hi|hello|hey( there)?|good (morning|afternoon|evening)|bye|goodbye|see you|no that'?s all|nothing else|"
    r"that'?s everything|brilliant|makes sense|sure|yes|yeah|no|nope|appreciate it|much appreciated|"
    r"that helps|helpful|wonderful|fantastic|excellent|good|fine|so|um|uh|well|for that|really|so much)"
    r"[\s,.!]*)+$")
GRATITUDE = (r"\b(thanks|thank you|cheers|appreciate (it|that|the help)|much appreciated|that'?s all|"
             r"that helps|got it|perfect|brilliant)\b")
REFINE = (
    r"\b(wait|actually|hang on|hold on|by the way|btw|one (more )?thing|forgot|should'?ve (said|mentioned)|"
    r"should have (said|mentioned)|i should (mention|say|add)|full disclosure|to be clear|realistically|what if|"
    r"and if|instead|make (it|that)|change (it|that)|scratch that|correction|turns out|update|just (heard|found out|"
    r"checked|looked|realised|realized|noticed)|looked at the \w+ again|i guess|now that)\b")
HYPOTHETICAL = (r"\b(what if|and if|does (that|it) change|would (that|it) change|does that affect|"
                r"what happens if|in that case|if we|if i|is that (gonna|going to) be a problem|"
                r"does that matter|is that ok(ay)?|still (apply|allowed|ok))\b")
STATEMENT_START = (r"^\W*((oh|wait|actually|and|so|hmm|also|but|by the way|one thing)[,\s]+)*"
                   r"(it's|it is|it'll|it was|we're|we are|we'll|i'm|i am|i'd|i got|i've|i was|the \w+ "
                   r"(is|was|are|were|got|has|had|includes?)|they're|there('s| will be| are)|make it|"
                   r"change it|we (got|had|have|need|moved|changed)|my \w+)")
QUESTION = (r"^\W*((oh|and|so|also|okay|ok|hey|hi|um|well)[,\s]+)*(what|what's|how|which|when|where|"
            r"who|why|is|are|do|does|can|could|should|will|would)\b")
ASK = (r"\b(tell me|let me know|i need to know|i want to know|i'?d like to know|wondering|any idea|"
       r"can you|could you|do you know|need (the|to know)|looking for)\b")
WH_OR_AUX = r"^(what|what's|how|which|when|where|who|can|could|do|does|is|are|should|will|would)\b|\?$"
REPLACE_CUE = (r"\b(instead|now|moved|changed|change it|change that|not|rather|switch(ed)?|no longer|"
               r"actually no|scratch that|correction|make it)\b")
REFINEMENT_OPENING = (r"^((oh|wait|actually|and|so|hmm|also|okay|ok|well|one thing|no|i forgot|"
                      r"i should mention)[,.\s]+)+")
LIST_STYLE, REPEAT_STYLE, SHORT_STYLE = r"bullet|points|list", r"\b(repeat|again|read that back)\b", r"short|brief|gist"
GATE_LABELS = ("retrieval", "refinement", "presentation", "chitchat")

# --------------------------------------------------------------------------- answers and citations
CITATION_GROUP = r"\[((?:Doc_[A-Za-z0-9_]+|[A-Za-z0-9_]+)\s*§\s*\d+(?:\s*[,;]\s*[A-Za-z0-9_]+\s*§\s*\d+)*)\]"
CITATION = r"([A-Za-z0-9_]+)\s*§\s*(\d+)"
QUANTITY_QUESTION = (
    r"\b(how much|how many|how long|how early|how late|how soon|how quickly|how often|"
    r"what'?s the (\w+ )?(rate|cost|price|fee|cap|limit|budget|amount|allowance|per diem)|"
    r"what (is|are) the (\w+ )?(rate|cost|price|fee|cap|limit|budget|amount|allowance)s?|"
    r"how far|how big|what time)\b")
DURATION_QUESTION = (r"\b(how long|how early|how late|how soon|how quickly|how often|deadline|by when|"
                     r"how many (days|weeks|months|hours|nights|years))\b")
MONEY_QUESTION = (
    r"\b(fee|fees|cost|costs|price|prices|rate|rates|charge|charges|budget|cap|caps|limit|limits|"
    r"allowance|per diem|spend|spending|amount|pay|paid|reimburse\w*|stipend|deductible)\b")
CURRENCY = r"\b(INR|USD|EUR|GBP|SGD|JPY|Rs\.?)\s?\d|\d+(\.\d+)?\s?%|\bper cent\b"
DURATION = (r"\d+\s*(-\s*\d+\s*)?(calendar |working |business )?(day|days|week|weeks|month|months|hour|"
            r"hours|minute|minutes|year|years|night|nights)\b")
CROSS_REFERENCE = (r"\b(see|is in|are in|set out in|described in|listed in|per|under|follow(s)?)\s+(the\s+)?"
                   r"([A-Z][\w ]+\()?Doc_\d+")
ATTRIBUTE_QUESTION = (r"\?|^(is|are|do|does|can|could|will|what|which|how|where|when|who)\b|\b(is there|are there|"
                      r"do they|does it|can they|can we|can i)\b")

# --------------------------------------------------------------------------- telemetry
EVENT_TYPES = (
    "session_started", "turn_started", "chunk_received", "controller_decision", "decomposition",
    "retrieval_started", "retrieval_completed", "evidence_fused", "retrieval_suppressed", "answer_started",
    "first_token", "answer_version", "grounding_check", "uncertainty_flag", "turn_completed", "session_ended",
)
REQUIRED_EVENTS = ("turn_started", "chunk_received", "controller_decision", "answer_version", "grounding_check",
                   "turn_completed")
RETRIEVAL_EVENTS = ("retrieval_started", "retrieval_completed")
REQUIRED_PAYLOAD = {
    "chunk_received": ("text", "partial"),
    "controller_decision": ("action", "gate", "reason", "final"),
    "retrieval_started": ("qid", "query", "trigger"),
    "retrieval_completed": ("qids", "t_dispatch", "t_start", "compute_ms", "used"),
    "first_token": ("ttft_ms",),
    "answer_version": ("version", "kind", "text", "citations"),
    "grounding_check": ("claims", "supported", "support_rate", "fabricated_ids"),
    "uncertainty_flag": ("message",),
    "turn_completed": ("kind", "latency", "cost", "retrieved", "early_retrieval"),
}
PAYLOAD_ENUMS = {
    ("controller_decision", "action"): ("wait", "retrieve", "suppress", "finalize"),
    ("retrieval_started", "trigger"): ("provisional", "multi_intent", "refinement", "final"),
    ("turn_completed", "kind"): GATE_LABELS,
}
EXPECTED_KIND = {"single": "retrieval", "compound": "retrieval", "unanswerable": "retrieval",
                 "refinement": "refinement", "presentation": "presentation", "chitchat": "chitchat"}
GATE_TARGETS = {"G2": 80.0, "G3": 70.0, "G4": 85.0, "G5": 80.0, "G6": 100.0}

# --------------------------------------------------------------------------- transcript timing
WORDS_PER_SECOND = 2.7
END_SILENCE_S = 0.35
PART_SIZES = (2, 3, 3, 4)
JITTER = (0.92, 1.08)
