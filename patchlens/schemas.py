"""Schemas of the library's records, as DDL. All fields may be null; arrays are in order."""

SRC_FUNCTION = "name string, file_path string, line_start int, line_end int, original_lines array<string>, strings array<string>, numbers array<string>, hash_value string"
BIN_FUNCTION = "name string, asm_codes array<string>, strings array<string>, numbers array<bigint>"
FUNCTION_PAIR = f"function_name string, bin_function_feature struct<{BIN_FUNCTION}>, src_function_features array<struct<{SRC_FUNCTION}>>"
CONFIRM_ITEM = "id int, label int, similarity double, function_name string, src_codes array<string>, src_strings array<string>, src_numbers array<string>, asm_codes array<string>, bin_strings array<string>, bin_numbers array<string>"
POSITION_ITEM = "id int, function_name string, src_length int, effective_src_length int, asm_length int, answer_length int, src_codes array<string>, asm_codes array<string>, answer_asm_codes array<string>"
SNIPPET_ITEM = "src_codes array<string>, asm_codes array<string>, label int"
CHOICE_ITEM = "function_name string, choice_index int, wrong_type int, asm_codes array<string>, src_codes_0 array<string>, src_codes_1 array<string>"
PATCH_LINES = "vul_snippet_codes array<string>, fixed_snippet_codes array<string>"
CASE_FUNCTION = f"function_name string, vul_source_codes array<string>, patches array<struct<{PATCH_LINES}>>"
TEST_CASE = (
    f"public_id string, affected_library string, vul_functions array<struct<{CASE_FUNCTION}>>, "
    "test_bin struct<library_name string, version_number string, version_tag string, binary_name string, binary_path string>, "
    "ground_truth struct<contained_vul_function_names array<string>, is_fixed boolean>"
)
LISTING = "binary string, line_no int, line string"
MAPPING = "binary string, function_no bigint, function_name string, mapping_no bigint, src_function string, src_path string, src_line int, is_discriminator boolean, src_codes array<string>, asm_codes array<string>"
LIBRARY_VERSION = "public_id string, library_id bigint, library_name string, vendor string, platform string, version_id bigint, version_number string"
PATCH_DETAIL = "public_id string, url string, raw string, hunk_code string, affected_file string, affected_function string"
HUNK = "change_context string, start_before int, size_before int, start_after int, size_after int, snippet_before array<string>, snippet_after array<string>"
SCORES = "has_vul_function boolean, has_vul boolean, diff_num int, vul_score double, fix_score double"
COMPILED_PATH = "function_save_path string, binary_base_dir string, effective_src_line_num int"
ANALYSIS = "over_filter_count bigint, confirmed_count bigint, located_count bigint, precise_count bigint, chosen_count bigint, tp bigint, fp bigint, tn bigint, fn bigint"
