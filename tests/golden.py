"""A small message graph and the results derived for it by hand-written Python."""

VERTICES = [
    (2732329846, "Michael"), (132988448, "David"), (473822999, "Sarah"), (2932436311, "Jean"),
    (2249679902, "Raphael"), (601389784, "Lucie"), (2941487254, "Harold"), (1192483885, "Pierre"),
    (465776805, "Christophe"), (838147628, "Zoe"), (2564641105, "Fabien"), (1518391292, "Nicolas"),
]
IDS = {name: vertex_id for vertex_id, name in VERTICES}

# sender, receiver and number of messages between them
MESSAGES = [
    ("Michael", "David", 2), ("Michael", "Harold", 3), ("Michael", "Lucie", 1), ("Lucie", "Michael", 4),
    ("Harold", "Pierre", 3), ("Harold", "David", 2), ("Harold", "Christophe", 1), ("David", "Zoe", 1),
    ("David", "Harold", 3), ("Zoe", "David", 1), ("Zoe", "Sarah", 1), ("Christophe", "Harold", 2),
    ("Christophe", "Lucie", 1), ("Christophe", "Raphael", 1), ("Raphael", "Christophe", 1),
    ("Jean", "Christophe", 2), ("Pierre", "Harold", 3), ("Fabien", "Nicolas", 1), ("Nicolas", "Fabien", 1),
]
EDGES = [
    (IDS[sender], IDS[receiver], f"{sender}-{receiver}-{n}")
    for sender, receiver, count in MESSAGES for n in range(count)
]

# name: in-degree, out-degree, triangles, strong component, PageRank
EXPECTED = {
    "Michael": (4, 6, 1, 132988448, 0.50946),
    "David": (5, 4, 1, 132988448, 1.20480),
    "Sarah": (1, 0, 0, 473822999, 0.32256),
    "Jean": (0, 2, 0, 2932436311, 0.15000),
    "Raphael": (1, 1, 0, 132988448, 0.35072),
    "Lucie": (2, 4, 0, 132988448, 0.42289),
    "Harold": (11, 6, 1, 132988448, 2.60433),
    "Pierre": (3, 3, 0, 132988448, 1.25684),
    "Christophe": (4, 4, 0, 132988448, 0.94456),
    "Zoe": (1, 2, 0, 132988448, 0.40602),
    "Fabien": (1, 1, 0, 1518391292, 1.00000),
    "Nicolas": (1, 1, 0, 1518391292, 1.00000),
}
CORES = {  # k: vertices, edges, {community: members}
    1: (12, 34, {132988448: 10, 1518391292: 2}),
    2: (11, 33, {132988448: 9, 1518391292: 2}),
    3: (6, 25, {132988448: 6}),
    4: (6, 25, {132988448: 6}),
    5: (5, 21, {132988448: 5}),
    6: (2, 6, {1192483885: 2}),
    7: (0, 0, {}),
}
LABELS = {
    "Michael": 2732329846, "David": 1192483885, "Sarah": 1192483885, "Pierre": 1192483885, "Jean": 2941487254,
    "Raphael": 2941487254, "Harold": 2941487254, "Zoe": 2941487254, "Lucie": 601389784, "Christophe": 465776805,
    "Fabien": 2564641105, "Nicolas": 1518391292,
}
NAME_IDS = {
    "Customer#000000017": 261608698353674981, "Michael": 3558116964364420258, "bob": 8721129839403347642,
    "abcdefgh": 889920568008030873, "Zoë": 3589520574056869333, "": 2819277119954315470,
}
