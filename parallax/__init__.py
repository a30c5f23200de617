"""Paired-representation measurement on Spark.

The stages of the analysis, each from DataFrame to DataFrame and lazy:

    measure     score vectors to token statistics
    map_steps   tokens and spans to step assignments
    summarise   token rows to trajectory rows
    contrast    trajectory rows to paired task and family contrasts
    infer       contrasts to statistics, adjusted p-values and decisions
    verdict     decisions of several models to cross-model verdicts
    render      programs to renderings in all conditions
"""

from parallax.functions.distribution import measure, measure_wide
from parallax.operators.decide import across_models as verdict
from parallax.operators.decide import decide
from parallax.operators.programs.frames import build, render_programs as render
from parallax.operators.spans import map_steps
from parallax.operators.summarise import trajectories as summarise
from parallax.plans.publish import contrasts_of as contrast
from parallax.plans.publish import summaries as infer

__all__ = ["build", "contrast", "decide", "infer", "map_steps", "measure", "measure_wide", "render", "summarise", "verdict"]
