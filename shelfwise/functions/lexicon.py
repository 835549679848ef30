"""The default stop words and synonyms of the tokenizer.

They must equal the published defaults for results to match; the synonym order
is part of the meaning because rules run one after the other.
"""

# Whole tokens are compared, so the phrases of the list match none.
STOPWORDS = [
    "game",
    "games",
    "player",
    "players",
    "players'",
    "play",
    "played",
    "playing",
    "turn",
    "turns",
    "round",
    "rounds",
    "phase",
    "phases",
    "action",
    "actions",
    "rule",
    "rules",
    "component",
    "components",
    "piece",
    "pieces",
    "token",
    "tokens",
    "card",
    "cards",
    "board",
    "boards",
    "setup",
    "set-up",
    "objective",
    "objectives",
    "includes",
    "included",
    "including",
    "feature",
    "features",
    "experience",
    "experiences",
    "gameplay",
    "playtime",
    "playing time",
    "gamers",
    "gaming",
    "victory",
    "win",
    "wins",
    "winning",
    "lose",
    "loses",
    "loss",
    "based",
    "uses",
    "use",
    "using",
    "through",
    "across",
    "within",
    "during",
    "made",
    "make",
    "makes",
    "allow",
    "allows",
    "allowed",
    "provide",
    "provides",
    "provided",
    "designed",
    "design",
    "designs",
    "theme",
    "themes",
    "version",
    "versions",
    "edition",
    "editions",
    "copy",
    "copies",
    "set",
    "sets",
    "box",
    "boxes",
    "collection",
    "collections",
    "additional",
    "various",
    "several",
    "multiple",
    "different",
    "specific",
    "special",
    "unique",
    "variety",
    "varieties",
    "varied",
    "varies",
    "type",
    "types",
    "kind",
    "kinds",
    "size",
    "sizes",
    "number",
    "numbers",
    "amount",
    "amounts",
    "objective-based",
    "component-based",
    "scenario",
    "scenarios",
    "mission",
    "missions",
    "mode",
    "modes",
    "fun",
    "exciting",
    "interesting",
    "challenging",
    "simple",
    "complex",
    "easy",
    "easily",
    "hard",
    "harder",
    "difficult",
    "difficulty",
    "fast",
    "faster",
    "slow",
    "slower",
    "quick",
    "quickly",
    "long",
    "short",
    "longer",
    "shorter",
    "optional",
    "option",
    "options",
    "playable",
    "players can",
    "players must",
    "allows players",
    "encourages players",
    "content",
    "contains",
    "contain",
    "containing",
    "description",
    "described",
    "describe",
    "describes",
]

SYNONYMS = {
    "worker-placement": ["worker placement", "worker-placement", "pawn placement"],
    "deck-building": ["deck building", "deckbuilding", "deck construction"],
    "dice-rolling": ["dice rolling", "rolling dice"],
    "roll-and-write": ["roll-and-write", "roll and write"],
    "push-your-luck": ["push your luck", "press your luck"],
    "pattern-building": ["pattern building", "pattern formation"],
    "engine-building": ["engine building", "engine-building", "progression engine"],
    "area-control": ["area control", "area dominance", "territory control"],
    "set-collection": ["set collection", "set-collecting"],
    "tile-placement": ["tile placement", "tile-laying", "tile laying"],
    "hand-management": ["hand management", "hand-management", "hand optimization"],
    "resource-management": ["resource management", "resource allocation"],
    "storytelling": ["storytelling", "narrative-driven", "narrative gameplay"],
    "cooperative": ["cooperative", "co-op", "cooperative play"],
    "competitive": ["competitive", "versus play", "player versus player"],
    "drafting": ["drafting", "card drafting"],
    "take-that": ["take that", "take-that"],
    "trading": ["trading", "exchange trading"],
    "market": ["market system", "market mechanism"],
    "economic": ["economic", "economic simulation"],
    "pickup-and-deliver": ["pick-up-and-deliver", "pick up and deliver", "pickup-delivery"],
    "memory": ["memory mechanic", "memorization mechanic"],
    "deduction": ["deduction", "logical deduction"],
    "social-deduction": ["social deduction", "hidden-role deduction"],
    "bluffing": ["bluffing", "intentional deception"],
    "negotiation": ["negotiation", "deal-making"],
    "auction": ["auction", "bidding"],
    "tactical": ["tactical", "tactical play"],
    "strategic": ["strategic", "strategy-focused"],
    "modular-board": ["modular board", "reconfigurable board"],
    "fantasy": ["fantasy", "fantasy theme"],
    "sci-fi": ["science fiction", "sci fi", "scifi"],
    "historical": ["historical", "history-based"],
    "war": ["war", "wargame"],
    "medieval": ["medieval", "middle-ages themed"],
    "renaissance": ["renaissance", "early-modern themed"],
    "horror": ["horror", "horror-themed"],
    "mystery": ["mystery", "detective mystery"],
    "adventure": ["adventure", "adventure-themed"],
    "exploration": ["exploration", "map exploration"],
    "thematic": ["thematic", "theme-driven"],
    "abstract": ["abstract", "abstract strategy"],
    "party": ["party game", "party-style game"],
    "family": ["family game", "family-friendly"],
    "two-player": ["two-player", "duel", "1v1"],
}
