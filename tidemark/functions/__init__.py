"""Column functions: no joins, no shuffles, all inside code generation but for the codecs."""
