"""Documents that every operator must take: null, empty and long texts, ties, repeats."""

EDGE = [(5, "Plain words here, and more."), (3, None), (4, ""), (None, "no id at all"), (9, "twice"), (9, "twice"),
        (7, "a  b\n\n c   "), (8, "x" * 3000 + " " + "long words " * 4000), (1, "Plain words here, and more."),
        (2, "Grüße, c'est déjà l'été; ¿qué? 12ab!? ² <|endoftext|> Σας İx"), (6, "   ")]
