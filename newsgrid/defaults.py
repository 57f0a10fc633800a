"""A small starter vocabulary.

Real deployments bring their own tables (see ``operators.lexicon`` for loading
them); these few words only make the jobs usable out of the box.
"""

from __future__ import annotations

from newsgrid.operators.lexicon import ArticleLexicon, IncidentLexicon

ARTICLES = ArticleLexicon(
    valence={"cheerful": 2.0, "radiant": 2.5, "soothing": 1.5, "neat": 1.0, "gloomy": -1.5,
             "shoddy": -2.0, "wretched": -2.5, "ghastly": -3.0},
    left=("rent ceiling", "worker cooperative"),
    right=("school vouchers", "small government"),
    topics={"travel": ("ferry", "timetable"), "cooking": ("recipe", "saucepan"),
            "music": ("orchestra", "violinist"), "gardening": ("compost", "greenhouse")},
    stop=("perhaps", "although", "tomorrow", "matter", "matters"),
)

INCIDENTS = IncidentLexicon(
    topics={"fire": ("haystack blaze", "chimney"), "flood": ("weir", "sandbags"),
            "accident": ("level crossing", "tailback"), "health": ("salmonella", "measles")},
    verbs={"fire": ("singed", "kindled"), "flood": ("drenched", "waterlogged"),
           "accident": ("skidded", "derailed"), "health": ("vomited",)},
    excluded=("chess problem", "jigsaw puzzle"),
    excluded_patterns=(r"\bmake-believe\b",),
    metaphors=("torrent of praise", "fire in the belly"),
    severe=("hospitalised", "flattened"), moderate=("scuffed", "delayed"),
    rescue=("winched", "hospitalised"), headline=("winched", "hospitalised", "marooned"),
    cues=("crossword", "letters page"),
)

TITLE_STOP_WORDS = ("Tonight", "Weekend", "Mayor", "Clerk", "Notice", "Bulletin")
