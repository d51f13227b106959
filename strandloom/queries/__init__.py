"""Registered queries."""


def core_registries() -> list:
    from strandloom.queries import formats, functions, kernels, operators, planted, problems

    return [problems.REG, functions.REG, operators.REG, kernels.REG, planted.REG, formats.REG]
