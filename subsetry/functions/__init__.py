"""Column functions: the text and hexadecimal codecs of exports."""
