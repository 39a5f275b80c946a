"""Closed vocabularies (PR-14). All tables here are fixed values: results depend on every entry."""

from __future__ import annotations

# Words that name no entity.
NON_ENTITY = ["scene", "image", "photo", "picture", "background", "foreground", "something", "someone", "object", "thing", "entity", "area", "view", "composition"]

# First words of relations that tell an attribute.
ATTRIBUTE_HEADS = ["is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "seem", "seems", "appear", "appears", "look", "looks", "colored", "coloured"]

# First words of relations that speak of the picture.
META_HEADS = [
    "based", "added", "aligned", "appeared", "anthropomorphized", "accentuated", "captured", "illustrated", "featuring", "showing", "depicting", "representing", "portraying",
    "displaying", "showcasing", "including", "consisting", "creating", "making", "describing", "presenting", "combining", "blending", "inspired", "designed", "arranged",
    "composed", "containing", "having", "being", "emphasizing", "symbolizing", "corresponding", "remaining", "existing", "related", "themed", "refined", "represented",
    "highlighted", "expressed", "associated", "connected", "linked", "derived", "inspired", "defined", "characterized", "known", "used", "seen", "shown", "found", "located",
]

# Relations that say too little.
VAGUE = ["of", "and", "with", "for", "to", "from"]

# Relations of the spatial and of the contact family.
SPATIAL = [
    "beside", "behind", "under", "over", "near", "around", "against", "inside", "above", "below", "along", "across", "among", "next to", "in front of", "on top of",
    "standing on", "sitting on", "lying on", "hanging from", "standing beside", "resting on", "leaning on", "walking on", "hiding behind", "floating on", "swimming in",
]
CONTACT = ["holding", "touching", "grabbing", "hugging", "kissing", "wearing", "carrying", "pulling", "pushing", "riding", "driving", "feeding", "eating", "drinking", "biting", "catching", "chasing", "throwing"]

# Words that make a relation a spatial one in quality checks.
PLACE_WORDS = [
    "on", "in", "at", "near", "over", "under", "behind", "beside", "inside", "outside", "above", "below", "against", "around", "across", "along", "between",
    "among", "atop", "upon", "front", "top",
]

# Relations that can be seen.
VISUAL = [
    "holding", "wearing", "riding", "driving", "pushing", "pulling", "carrying", "touching", "hugging", "kissing", "biting", "feeding", "eating", "drinking", "chasing", "catching",
    "throwing", "catching", "sitting on", "standing on", "standing beside", "lying on", "hanging from", "leaning on", "sleeping on", "walking on", "jumping on", "jumping from",
    "climbing on", "looking at", "pointing at", "talking to", "playing with", "hiding behind", "hiding under", "in front of", "behind", "next to", "on top of", "under", "inside",
    "surrounded by", "wrapped around", "attached to", "tied to", "flying over", "swimming in", "floating on", "falling from", "coming out of", "going into", "covering", "blocking",
    "supporting", "crushing", "hugging",
]

# Groups of synonyms; a term may be in several, and they aren't transitive.
SYNONYMS = [
    ["standing beside", "standing next to", "standing by", "standing near", "beside", "next to"],
    ["sitting on", "sitting upon", "seated on"],
    ["on top of", "on top", "atop"],
    ["in front of", "in front"],
    ["holding", "grasping", "clutching"],
    ["looking at", "looking towards", "gazing at", "watching"],
    ["interacting with", "engaging with"],
    ["placed on", "resting on", "lying on"],
    ["crafted with", "crafted from"],
    ["shaped like", "shaped into"],
    ["merged with", "combined with", "fused with"],
    ["balancing on", "balanced on", "balanced on top of"],
    ["submerged in", "immersed in", "sunk in"],
]
# Further groups, for generated candidates.
MORE_SYNONYMS = [
    ["on", "upon", "on top of", "on top", "atop"],
    ["in", "inside", "within", "into"],
    ["near", "nearby", "close to", "next to", "beside", "adjacent to"],
    ["under", "underneath", "beneath", "below"],
    ["over", "above", "over top of"],
    ["looking at", "watching", "gazing at", "staring at", "looking towards"],
    ["cutting", "tearing", "slicing", "chopping", "snipping"],
    ["touching", "contacting"],
]

# Lemmas of irregular forms.
LEMMAS = {
    "held": "hold", "holding": "hold", "holds": "hold", "worn": "wear", "wearing": "wear", "wears": "wear", "ridden": "ride", "riding": "ride", "rides": "ride",
    "sat": "sit", "sitting": "sit", "sits": "sit", "stood": "stand", "standing": "stand", "stands": "stand", "lay": "lie", "lying": "lie", "lain": "lie",
    "seen": "see", "seeing": "see", "sees": "see", "watched": "watch", "watching": "watch", "watches": "watch", "grasped": "grasp", "grasping": "grasp",
    "clutched": "clutch", "clutching": "clutch", "carried": "carry", "carrying": "carry", "ate": "eat", "eaten": "eat", "eating": "eat", "driven": "drive", "driving": "drive",
}
# Third persons of irregular verbs.
THIRD_PERSONS = {"have": "has", "do": "does", "be": "is", "go": "goes", "wear": "wears"}

# Heads that introduce a picture rather than relate two entities, and auxiliaries, which aren't heads either.
SPAN_META_HEADS = [
    "showing", "featuring", "depicting", "illustrated", "highlighting", "representing", "portraying", "displaying", "showcasing", "including", "consisting",
    "using", "creating", "making", "looking", "seeing", "describing", "presenting", "combining", "blending", "merging", "inspired", "designed", "arranged",
    "composed", "containing", "having", "being", "emphasizing", "symbolizing", "corresponding", "remaining", "existing", "interesting", "amazing", "unexpected",
    "striking", "setting", "organized", "detailed", "related", "colored", "patterned", "stacked", "themed", "surrounded",
]
SPAN_AUXILIARIES = ["is", "are", "been", "being", "has", "have"]

# Prepositions of several words, in the order in which they are tried, and single ones.
COMPOUND_PREPOSITIONS = ["in front of", "on top of", "next to", "out of", "because of", "on top", "in front"]
SINGLE_PREPOSITIONS = [
    "onto", "into", "upon", "atop", "from", "with", "beside", "between", "among", "amidst", "through", "across", "along", "around", "against", "under", "over",
    "behind", "inside", "outside", "above", "below", "within", "without", "toward", "towards", "near", "together", "apart", "off", "out", "on", "in", "at", "to",
    "by", "as", "for", "like", "via", "of",
]

# Prepositions that may begin a relation; those of several words in the order in which they are tried.
LEADING_COMPOUNDS = ["in front of", "on top of", "next to", "out of", "inside of", "outside of", "on top", "in front"]
LEADING_PREPOSITIONS = [
    "onto", "into", "upon", "atop", "from", "with", "beside", "between", "among", "through", "across", "along", "around", "against", "under", "over", "behind",
    "inside", "outside", "above", "below", "within", "toward", "towards", "near", "off", "out", "on", "in", "at", "to", "by", "of", "underneath", "beneath",
]

# Fixed values for questions: participles, places in the order of the published list, verbs after do and does, words that
# end in ing and are no verbs, words after do and does that are no verbs, and adjectives that end a question.
PARTICIPLES = [
    "made", "located", "filled", "cut", "numbered", "positioned", "surrounded", "aimed", "cooked", "covered", "attached", "connected", "painted", "dressed",
    "seated", "placed", "used", "shown", "hidden", "parked", "closed", "opened",
]
PLACES = [
    "in front of", "next to", "on top of", "out of", "inside", "outside", "behind", "under", "above", "below", "against", "along", "around", "between", "beside",
    "near", "over", "onto", "into", "across", "atop", "on", "in", "at", "by",
]
DOES_VERBS = ["wear", "have", "play", "hold", "contain", "go", "pull", "stand", "smile", "drink", "jump", "guide", "shop", "drive", "ride"]
NOT_GERUNDS = [
    "ceiling", "parking", "something", "anything", "everything", "nothing", "morning", "evening", "king", "ring", "wing", "spring", "string", "pudding",
    "sibling", "dumpling", "sterling", "building", "according",
]
NOT_VERBS = [
    "the", "a", "an", "in", "on", "of", "image", "and", "or", "with", "from", "to", "his", "her", "their", "any", "some", "blue", "red", "black", "white",
    "yellow", "green", "pink", "gray", "grey", "brown",
]
LAST_ADJECTIVES = ["open", "closed", "black", "white", "red", "full", "empty", "visible", "on", "off", "asleep", "awake", "together"]
