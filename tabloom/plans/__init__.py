"""Jobs composed of operators: preparation, synthesis and judging, sweeps, comparison."""
