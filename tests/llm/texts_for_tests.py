"""Words and prose that the tests of the training-data operators share."""

import random

WORDS = [w for w in "the of and to a in that it is was for on with as at by from this have are but not they his her she or an will my one all would there their what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us river stone window garden letter market winter summer music paper".split()]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("aeiou") + rng.choice("bdkmst") if rng.random() < 0.5 else "") for _ in range(n))
