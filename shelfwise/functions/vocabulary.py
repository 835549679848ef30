"""The label vocabularies of the feature explanations.

They must equal the published lists for results to match, entry by entry and in
this order, because matches are reported in vocabulary order.
"""

MECHANICS = [
    "acting",
    "action event",
    "action drafting",
    "action points",
    "action queue",
    "action retrieval",
    "action timer",
    "advantage token",
    "alliances",
    "area majority influence",
    "area movement",
    "area impulse",
    "auction bidding",
    "auction compensation",
    "auction: dexterity",
    "auction: dutch",
    "auction: dutch priority",
    "auction: english",
    "auction: fixed placement",
    "auction: multiple lot",
    "auction: once around",
    "auction: sealed bid",
    "auction: turn order until pass",
    "automatic resource growth",
    "betting and bluffing",
    "bingo",
    "bribery",
    "card play conflict resolution",
    "catch the leader",
    "chaining",
    "closed drafting",
    "closed economy auction",
    "contracts",
    "cooperative game",
    "deck bag and pool building",
    "deduction",
    "delayed purchase",
    "dice rolling",
    "die icon resolution",
    "enclosure",
    "end game bonuses",
    "follow",
    "grid movement",
    "hand management",
    "hidden movement",
    "hidden roles",
    "hidden victory points",
    "i cut you choose",
    "income",
    "increase value of unchosen resources",
    "investment",
    "kill steal",
    "king of the hill",
    "ladder climbing",
    "legacy game",
    "loans",
    "lose a turn",
    "mancala",
    "map addition",
    "map reduction",
    "matching",
    "memory",
    "modular board",
    "move through deck",
    "movement points",
    "multi use cards",
    "negotiation",
    "network and route building",
    "once per game abilities",
    "open drafting",
    "order counters",
    "paper and pencil",
    "pattern building",
    "pattern recognition",
    "pick up and deliver",
    "player elimination",
    "point to point movement",
    "predictive bid",
    "programmed movement",
    "push your luck",
    "race",
    "real time",
    "resource queue",
    "role playing",
    "roles with asymmetric information",
    "roll spin and move",
    "scenario mission campaign game",
    "score and reset game",
    "secret unit deployment",
    "selection order bid",
    "semi cooperative game",
    "set collection",
    "simulation",
    "simultaneous action selection",
    "solo solitaire game",
    "stacking and balancing",
    "stock holding",
    "storytelling",
    "take that",
    "targeted clues",
    "team based game",
    "tech trees tech tracks",
    "tile placement",
    "trading",
    "traitor game",
    "trick taking",
    "turn order: auction",
    "turn order: random",
    "variable player powers",
    "variable set up",
    "voting",
    "worker placement",
]

THEMES = [
    "abstract strategy",
    "action dexterity",
    "adventure",
    "american west",
    "ancient",
    "animals",
    "arabian",
    "aviation flight",
    "bluffing",
    "book",
    "card game",
    "children's game",
    "city building",
    "civilization",
    "comic book strip",
    "deduction",
    "dice",
    "economic",
    "educational",
    "electronic",
    "environmental",
    "expansion for base game",
    "exploration",
    "fantasy",
    "farming",
    "fighting",
    "game system",
    "horror",
    "humor",
    "industry manufacturing",
    "math",
    "medical",
    "medieval",
    "memory",
    "modern warfare",
    "movies tv radio theme",
    "murder mystery",
    "music",
    "mythology",
    "nautical",
    "negotiation",
    "novel based",
    "number",
    "party game",
    "pirates",
    "political",
    "prehistoric",
    "print & play",
    "puzzle",
    "racing",
    "real time",
    "renaissance",
    "science fiction",
    "space exploration",
    "spies secret agents",
    "sports",
    "territory building",
    "trains",
    "transportation",
    "travel",
    "trivia",
    "video game theme",
    "wargame",
    "word game",
    "zombies",
]
