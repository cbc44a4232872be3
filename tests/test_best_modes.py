"""The choice of predictors tile after tile against a plain one, and its residuals against those of each mode."""

import math
from collections import Counter


from glyphgrid.operators import grid, predict
from glyphgrid.plans.fixtures import images

D = "/root/testdata/sf0.001"
CHOSEN = "image_id in (0, 3, 4, 5, 7, 12)"


def plain_bits(own, known):
    entropy = lambda c: sum(c.values()) * math.log2(sum(c.values())) - sum(n * math.log2(n) for n in c.values() if n) if c else 0.0
    bits = 0.0
    for k in range(4):
        bits += entropy(own[k]) + entropy(own[k] + known[k])
        bits -= 0.1 * (own[k][0] + sum(0.94 * 0.6 ** (i - 1) * (own[k][i] + own[k][256 - i]) for i in range(1, 16)))
    return round(bits, 6)


def test_choice_and_residuals_equal_the_plain_ones(spark):
    size = 4
    rasters = images(spark, D).filter(CHOSEN)
    by_mode = {m: {(r.image_id, r.y, r.x): [r[c] for c in grid.CHANNELS] for r in grid.exploded(predict.residuals(rasters, m)).collect()} for m in range(14)}
    got = {r.image_id: r for r in predict.best_modes(rasters, size).collect()}
    kept = {(r.image_id, r.y, r.x): [r[c] for c in grid.CHANNELS] for r in grid.exploded(predict.predicted_image(rasters, size)).collect()}
    for image in rasters.select("image_id", "w", "h").collect():
        across, down = -(-image.w // size), -(-image.h // size)
        known, modes = [Counter() for _ in range(4)], {}
        for ty in range(down):
            for tx in range(across):
                places = [(image.image_id, y, x) for y in range(ty * size, min(image.h, ty * size + size)) for x in range(tx * size, min(image.w, tx * size + size))]
                own = {m: [Counter(by_mode[m][p][k] for p in places) for k in range(4)] for m in range(14)}
                bits = {m: round(plain_bits(own[m], known) - 15 * (modes.get((ty, tx - 1)) == m) - 15 * (modes.get((ty - 1, tx)) == m), 6) for m in range(14)}
                mode = modes[ty, tx] = min(range(14), key=lambda m: (bits[m], m))
                known = [a + b for a, b in zip(known, own[mode])]
                assert all(kept[p] == by_mode[mode][p] for p in places)
        row = got[image.image_id]
        assert row.across == across and list(row.modes) == [modes[y, x] for y in range(down) for x in range(across)]
